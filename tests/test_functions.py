import hashlib
import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import net, observables, text, timeparse, vector


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1755162700.12", 1755162700.12), ("1755162700120", 1755162700.12), ("2026-08-14T09:31:44Z", 1786699904.0), ("2026-08-14T09:31:44.221+0000", 1786699904.221), ("20260814T093144Z", 1786699904.0), ("2026-08-14", 1786665600.0), ("now", None), ("epoch", None), ("T10:00", None), ("2026-8-4", None), ("-5", None), ("5e10", None), ("", None), (None, None)],
)
def test_epoch(spark, raw, want):
    got = one(spark, timeparse.epoch(F.col("t")), t=raw)
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-5)


@pytest.mark.parametrize(("raw", "loose", "strict"), [("1.2.3.4", True, True), ("01.02.03.04", True, False), ("256.1.1.1", False, False), ("1.2.3", False, False), ("1.2.3.4.", False, False), ("²1.2.3.4", False, False), (None, False, False)])
def test_quads(spark, raw, loose, strict):
    assert one(spark, net.is_dotted_quad(F.col("t")), t=raw) is loose
    assert one(spark, net.is_strict_v4(F.col("t")), t=raw) is strict


def test_ranges(spark):
    cidrs = ["10.0.0.0/8", "fe80::/10", "255.255.255.255/32"]
    rows = [("10.255.0.1", True), ("11.0.0.1", False), ("fe80::1", True), ("2001:db8::1", False), ("255.255.255.255", True), ("x", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert [r["got"] for r in df.select(net.in_any(F.col("t"), cidrs).alias("got")).collect()] == [w for _, w in rows]
    ips = spark.createDataFrame([("::1",), ("1.2.3.4",), ("1.2.3",), (None,)], "t string").select(net.is_ip(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in ips] == [True, True, False, False]


def test_addresses_like_the_standard_library(spark):
    rng, parts = random.Random(12), ["1", "ab", "0", "ffff", "12345", "g", ":", "::", ":", ":", "1.2.3.4", "01.2.3.4", "%eth0", "%", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    texts += [":".join(rng.choice(["1", "a", "", "ffff"]) for _ in range(rng.randint(5, 9))) for _ in range(3000)]
    texts += ["::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", ":::", "1.2.3.4", "0.0.0.0", "1.2.3.04", ""]

    def want(x):
        try:
            ipaddress.ip_address(x)
        except ValueError:
            return False
        return True

    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", net.is_ip(F.col("t")).alias("x")).collect()
    assert [r["t"] for r in got if r["x"] != want(r["t"])] == []


def test_observables(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    raw = f"get http://a.example/p from 1.2.3.4 and 999.1.1.1 {digest} b.example A.EXAMPLE B.example 1.2.3.4 2001:db8:0:1:2:3:4:5"
    assert one(spark, observables.observables(F.col("t")), t=raw) == ["http://a.example/p", digest, "1.2.3.4", "2001:db8:0:1:2:3:4:5", "b.example"]
    assert one(spark, observables.observables(F.col("t")), t=None) == []
    assert len(one(spark, observables.observables(F.col("t")), t=" ".join(f"h{i}.example" for i in range(90)))) == 64


def test_text(spark):
    assert one(spark, text.coerced(F.col("t")), t=" a\tb\x00\nc ") == "a b c"
    assert one(spark, text.coerced(F.col("t")), t=" \x01 ") is None
    assert one(spark, text.slug(F.col("t")), t="Hello, World -- again!") == "hello-world-again"
    assert one(spark, text.shortened(F.col("t"), 5), t="abc   defg") == "abc…"
    assert one(spark, text.sanitised_target(F.col("t")), t="ho st;rm") == "ho-st-rm"
    assert one(spark, text.parent_name(F.col("t")), t="/a/b/c.md") == "b"
    assert one(spark, text.sri_hex(F.col("t")), t="sha256-" + "AAAA") == "000000"


def test_windows_round_trip(spark):
    body = "  " + "word " * 400 + "\n" * 900 + "end"
    rows = one(spark, text.windows(F.col("t")), t=body)
    assert all(body[r["char_start"] : r["char_start"] + len(r["text"])] == r["text"] and r["text"] for r in rows)
    assert rows[0]["char_start"] == 2 and rows[-1]["index"] > len(rows) - 1
    assert one(spark, text.windows(F.col("t")), t="") == []


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r["x"] for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert math.isclose(got[0], 1 / math.sqrt(2)) and got[1:] == [0.0, None]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimensions differ"):
        bad.select(vector.cosine(F.col("a"), F.col("b"))).collect()
    bins = one(spark, vector.letter_histogram(F.col("t")), t="aAé")
    assert bins[ord("a") % 32] == 2 and bins[0xE9 % 32] == 1 and sum(bins) == 3
