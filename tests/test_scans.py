"""Scans that no task sees whole: parts by budget, numbered lines and tails of files, range joins, incidents."""

import ipaddress
import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import net
from emberwatch.operators import audit, budget, components, incidents, inventory


def fold(rows, most, reached=False):
    out, part, used = {}, 0, None
    for key, n in rows:
        n = max(n or 0, 0)
        if used is not None and (used >= most if reached else used + n > most):
            part, used = part + 1, 0
        used = (used or 0) + n
        out[key] = part
    return out


@pytest.mark.parametrize("reached", [False, True])
@pytest.mark.parametrize("most", [1, 100, 5000])
def test_parts_as_by_a_fold(spark, monkeypatch, most, reached):
    """Zero, null, negative and too large sizes, groups of one block, of just one and of many; a null group."""
    monkeypatch.setattr(budget, "BLOCK", 50)
    rng = random.Random(1)
    sizes = [("a", 700), ("b", 49), ("c", 50), ("d", 51), (None, 120), ("z", 1)]
    data = [(g, k, rng.choice([0, 1, 3, 9, 40, None, -5, 200, 10_000 if rng.random() < 0.02 else 2])) for g, n in sizes for k in range(n)]
    df = spark.createDataFrame(data, "g string, k long, n long").repartition(5)
    got = {(r["g"], r["k"]): r["part"] for r in budget.numbered(df, "g", "k", "n", most, reached=reached).collect()}
    want = {}
    for g, _ in sizes:
        want |= {(g, k): p for k, p in fold([(k, n) for x, k, n in data if x == g], most, reached).items()}
    assert got == want


def test_a_group_of_a_million_items(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("k"), (F.crc32(F.col("id").cast("string")) % 97).alias("n"))
    got = budget.numbered(df, None, "k", "n", 1000).select("k", "part").toPandas()
    assert dict(zip(got["k"].tolist(), got["part"].tolist(), strict=True)) == fold([(k, zlib.crc32(str(k).encode()) % 97) for k in range(1_000_000)], 1000)


def test_parts_of_nothing_and_bad_budgets(spark):
    df = spark.createDataFrame([], "g string, k long, n long")
    assert inventory.parts(df, "g", "k", "n", 5).count() == 0
    with pytest.raises(ValueError):
        budget.numbered(df, "g", "k", "n", 0)
    log = spark.createDataFrame([(k, s) for k, s in enumerate([5, 5, 1, 30, 2, 9, 1])], "seq long, size int")
    assert [r["segment"] for r in audit.rotated(log, 10).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 3]


def together(rows, window, hub):
    """Incident of each record by all pairs."""
    partners = {}
    for _, _, named in rows:
        for x in named or []:
            partners.setdefault(x, set()).update(y for y in named if y != x)
    up = {r: r for r, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_entity = {}
    for r, at, named in rows:
        for x in set(named or []) if at is not None else ():
            if len(partners[x]) <= hub:
                by_entity.setdefault(x, []).append((at, r))
    for own in by_entity.values():
        own.sort()
        for (t, a), (u, b) in zip(own, own[1:], strict=False):
            if u - t <= window:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
    return {r: find(r) for r in up}


def test_incidents_by_all_pairs(spark):
    """Chains over entities and time, records at the same time, hubs, records that name nothing or have no time."""
    rng = random.Random(6)
    names = [f"user:u{k}" for k in range(40)] + [f"host:h{k}" for k in range(15)]
    rows = []
    for r in rng.sample(range(10_000), 300):
        named = rng.sample(names, rng.choice([0, 1, 1, 2])) + (["address:hub"] if rng.random() < 0.5 else [])
        rows.append((r, rng.choice([None, *[round(rng.uniform(-500, 5000), 1)] * 20, 77.0]), rng.choice([named, named, named + named, None if not named else named])))
    df = spark.createDataFrame(rows, "record_id long, at double, entities array<string>")
    got = {r["record_id"]: r["incident_id"] for r in incidents.assigned(df, window=60, hub=30).collect()}
    assert got == together(rows, 60, 30)
    assert len(set(got.values())) > 100 and any(k != v for k, v in got.items())


def test_chain_of_links_in_few_rounds(spark):
    n = 400
    order = random.Random(7).sample(range(n), n)
    df = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(5, 5), (None, 3), (9000, 9001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert roots == {**dict.fromkeys(range(n), 0), 9000: 9000, 9001: 9000}


def test_incident_scores(spark):
    rows = [(1, 0.0, "a", 10.0, ["user:x"]), (2, 5.0, "a", 30.0, ["user:x", "host:y"]), (3, 9.0, "b", 20.0, ["host:y"]), (4, None, "b", 99.0, None)]
    df = spark.createDataFrame(rows, "record_id long, at double, source string, score double, entities array<string>")
    out = [tuple(r) for r in incidents.incidents(df, window=10, hub=5).orderBy("incident_id").collect()]
    assert out == [(1, 3, 2, ["a", "b"], 0.0, 9.0, 9.0, 62.5), (4, 1, 0, ["b"], None, None, None, 99.0)]
    assert incidents.incidents(df.limit(0), window=10, hub=5).count() == 0
    with pytest.raises(ValueError):
        incidents.assigned(df, window=0, hub=5)


def test_version_6_bits_as_by_the_standard_library(spark):
    rng = random.Random(9)
    texts = ["::", "::1", "1::", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "1::2::3", "1:2:3", "12345::", "::1.2.3", "::1.2.3.256", "1:2:3:4:5:6:7:8:9", "g::", "1.2.3.4", "", None, ":", "::%", "1:2:3:4:5:6:1.2.3.4", "ABCD::Ef"]
    for _ in range(300):
        own = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, (2**16 - 1) << 64, 2**64 - 1, 255]))
        texts += [str(own), own.exploded.upper()]

    def bits(text):
        try:
            n = int(ipaddress.IPv6Address(text or ""))
        except ValueError:
            return None
        return tuple(x - 2**64 if x >> 63 else x for x in (n >> 64, n & 2**64 - 1))

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", net.v6_bits(F.col("t")).alias("b")).collect()
    assert all((r["b"] and tuple(r["b"])) == bits(r["t"]) for r in got)


def test_addresses_in_a_hundred_thousand_ranges(spark):
    """The longest range of either version, without comparing all with all."""
    rng = random.Random(10)
    v6 = lambda n: str(ipaddress.IPv6Address(0x20010DB8 << 96 | n))
    nets = {ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(40) << 56, n), strict=False) for n in (0, 32, 48, 60, 64, 65, 72) for _ in range(15_000)}
    nets |= {ipaddress.ip_network((rng.getrandbits(32), n), strict=False) for n in (4, 8, 16, 24, 31, 32) for _ in range(2000)}
    listed = sorted(nets, key=str)
    values = [v6(int(n.network_address) & 2**96 - 1 | 5) for n in rng.sample([n for n in listed if n.version == 6], 60)] + [v6(rng.getrandbits(96)) for _ in range(20)]
    values += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)] + ["nothing", "::1", None]

    def longest(value):
        try:
            own = ipaddress.ip_address(value or "")
        except ValueError:
            return None
        return max((n for n in listed if n.version == own.version and own in n), key=lambda n: n.prefixlen, default=None)

    ranges = spark.createDataFrame([(str(n),) for n in listed] + [("bad",), ("1.2.3.4/40",)], "cidr string")
    df = net.in_ranges(spark.createDataFrame([(v,) for v in values], "value string"), ranges)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    assert {r["value"]: r["cidr"] for r in df.collect()} == {v: str(n) for v in set(values) if (n := longest(v))}
    assert net.in_ranges(spark.createDataFrame([("1.2.3.4",)], "value string"), ranges.limit(0)).count() == 0


def test_ranges_of_customers_whose_number_fills_more_than_a_group(spark, tmp_path):
    from emberwatch.plans import registry

    keys = [0, 5, 65_535, 65_536, 65_541, 84_025, 1_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, n) for i, k in enumerate([*keys, 70_000_001]) for n in range(21 * i, 21 * i + 21)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["address_ranges"](spark, str(tmp_path)).collect())
    want = set()
    for c, n in orders:
        k, s, h, known = n % 3, n % 7, n % 200, c in keys
        if k == 1:
            want.add((f"10.{c // 256 % 256}.{c % 256}.{h}", f"10.{c // 256 % 256}.{c % 256}.0/24" if c % 2 == 0 and known else "10.0.0.0/8"))
            continue
        value, group = (f"2001:db8:{c:x}:{s}::{h}", s) if k == 0 else (f"2001:0DB8:{c:X}:0:0:0:0.0.0.{h}", 0)
        want.add((value, f"2001:db8:{c:x}:{group}::/64" if c % 3 == 1 and known and c % 7 == group else f"2001:db8:{c:x}::/48" if c % 3 < 2 and known else "2001:db8::/32"))
    assert got == sorted(want)
