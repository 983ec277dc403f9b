import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import components, simhash


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(texts)], "doc_id long, text string")


def brute(fps, ids, most):
    """Smallest id reachable, by comparing all pairs."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    values = [int.from_bytes(f) for f in fps]
    for i in range(len(fps)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_by_definition():
    import xxhash

    for text in ("A b  c\td", "one", "", None, "x y", "É é a b c É é a b c", "a a a a a a"):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int.from_bytes(simhash.fingerprint(text, 3, 64)) == want


def test_chunks_change_nothing(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = simhash.fingerprint(text, 3, 64)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 3, 64) == whole


@pytest.mark.parametrize("cell", [512, 8])
def test_groups_against_all_pairs(spark, monkeypatch, cell):
    """Random fingerprints in clusters, linked at three bits; small cells cut the large keys."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "LEADERS", cell // 4)
    rng = random.Random(5)
    values = []
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(40):
            values.append(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.7 else v)
    values += [rng.getrandbits(64) for _ in range(60)] + values[:30]
    fps = [v.to_bytes(8) for v in values]
    ids = rng.sample(range(10_000), len(fps))
    monkeypatch.setattr(simhash, "fingerprints", lambda d, n, b: d.select("doc_id", F.col("text").cast("binary").alias("fp")))
    rows = spark.createDataFrame(list(zip(ids, map(bytearray, fps), strict=True)), "doc_id long, text binary")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(rows).collect()}
    assert got == dict(zip(ids, brute(fps, ids, 3), strict=True))


def test_keys_are_complete_for_three_bits():
    keys, rng = simhash.pigeonhole_keys(64, 6, 3), random.Random(1)
    for _ in range(500):
        off = set(rng.sample(range(64), 3))
        assert any(not off & set(k) for k in keys)


def test_edge_cases(spark):
    got = simhash.simhash_groups(docs(spark, [None, "", "a b c d", "a b c d", "x"], [5, 3, 9, None, 1])).collect()
    by = {(r["doc_id"], bytes(r["fp"])): r["component_id"] for r in got}
    assert len(got) == 5 and by[5, bytes(8)] == by[3, bytes(8)] == 3
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [9]
    assert simhash.simhash_groups(docs(spark, ["a"]).filter("false")).count() == 0
    odd = docs(spark, ["a b c", "a b c"]).withColumns({"fp": F.lit(1), "nid": F.lit(2), "key": F.lit(3), "component_id": F.lit(4)})
    assert {r["component_id"] for r in simhash.simhash_groups(odd).collect()} == {0}


def test_keep_one(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    far = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base), " ".join(near), " ".join(far), " ".join(base), None, ""]
    kept = simhash.keep_one(docs(spark, texts, [10, 4, 6, 11, 12, None]).withColumn("lang", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 6, 12]  # the row without an id is a copy of 12
    twice = docs(spark, [texts[0], texts[0]], [1, 1])
    assert simhash.keep_one(twice).count() == 1
    shared = docs(spark, [texts[0], texts[0], texts[2]], [1, 2, 2])  # a row that shares only its id with a copy
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(shared).collect()) == sorted([(1, texts[0]), (2, texts[2])])
    other = docs(spark, [texts[0]] * 3, [1, 1, 2]).withColumn("d", F.monotonically_increasing_id())
    assert [r["doc_id"] for r in simhash.keep_one(other).collect()] == [1]
    assert simhash.keep_one(twice.filter("false")).count() == 0


def test_keys_follow_the_number_of_fingerprints():
    for n in (10, 10_000, 10_000_000):
        keys = simhash.near_keys(n)
        width = len(keys[0])
        assert n / 2**width <= 8 and all(len(set(k)) == width for k in keys)
        agree = 1 - np.arccos(2 * 0.8 / 1.8) / np.pi
        assert (1 - agree**width) ** len(keys) <= 1.1e-3


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[x] == min(seen)
    assert set(got) == set(near)


def jaccard(a, b, n=5):
    own = [{tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b)]
    return len(own[0] & own[1]) / len(own[0] | own[1])


def planted(rng, low, high, count):
    """Pairs of texts whose exact five-word similarity is in [low, high)."""
    words, out = [f"w{i}" for i in range(5000)], []
    while len(out) < count:
        own = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        other = list(own)
        for _ in range(max(1, round(len(own) * rng.uniform(0.01, 0.06)))):
            other[rng.randrange(len(other))] = rng.choice(words)
        if low <= jaccard(" ".join(own), " ".join(other)) < high:
            out += [(" ".join(own), " ".join(other))]
    return out


@pytest.mark.parametrize("cell", [512, 8])
def test_near_groups_are_verified(spark, monkeypatch, cell):
    """No pair below the limit joins, not in a family of related texts either; true links inside the family do."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "LEADERS", cell // 4)
    monkeypatch.setattr(simhash, "ROUNDS", 1)
    rng = random.Random(4)
    pairs = planted(rng, 0.65, 0.79, 120)
    family = [[f"v{rng.randrange(5000)}" for _ in range(200)]]
    for _ in range(40):  # each a change of an earlier one
        own = list(rng.choice(family))
        for _ in range(rng.choice([2, 6])):
            own[rng.randrange(200)] = f"v{rng.randrange(5000)}"
        family.append(own)
    texts = [t for p in pairs for t in p] + [" ".join(f) for f in family]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, texts), **simhash.NEAR).collect()}
    assert all(got[i] == i for i in range(2 * len(pairs)))
    at, up = 2 * len(pairs), list(range(len(family)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in range(len(family)):
        for j in range(i):
            if jaccard(texts[at + i], texts[at + j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert 1 < len({find(i) for i in up}) < len(family)
    assert [got[at + i] for i in range(len(family))] == [at + find(i) for i in range(len(family))]


def test_pairs_close_to_the_limit_are_found(spark):
    """Recall between similarities of 0.80 and 0.85, by exact similarity and without the keys."""
    pairs = planted(random.Random(8), 0.8, 0.85, 300)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, [t for p in pairs for t in p]), **simhash.NEAR).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 0.97 * 300


def test_near_groups_of_the_table_by_exact_similarity(spark):
    """All pairs of the smallest table by their five-word sets, without fingerprints."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    words = {i: t.encode().lower().split() for i, t in own.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    up = {i: i for i in own}

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in own:
        for j in own:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows, **simhash.NEAR).collect()}
    assert got == {i: find(i) for i in own}


def test_large_groups_cost_what_their_size_costs(spark, monkeypatch):
    """Near copies of five related templates in one group: rows that are compared grow with the members, not with their square."""
    rng, words = random.Random(6), [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    templates = []
    for _ in range(5):  # 0.5 to 0.7 alike each other
        own = list(base)
        for at in rng.sample(range(120), 6):
            own[at] = rng.choice(words)
        templates.append(own)

    def group(n):
        out = []
        for i in range(n):
            own = list(templates[i % 5])
            own[rng.randrange(120)] = f"x{i}"
            out.append(" ".join(own))
        return out

    seen, plain = [], simhash._sorted
    monkeypatch.setattr(simhash, "CELL", 32)
    monkeypatch.setattr(simhash, "LEADERS", 8)
    monkeypatch.setattr(simhash, "_sorted", lambda cells: seen.append(cells.count() if "own" in cells.columns else 0) or plain(cells))
    moved = {}
    for n in (400, 1600):
        seen.clear()
        texts = group(n)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, texts), keys=[[]], most=128).collect()}
        first = [t.split() for t in texts[:10]]
        apart = {i for i in range(5) if not any(jaccard(" ".join(first[i]), " ".join(first[j])) >= 0.8 for j in range(5) if j != i)}
        assert len(apart) >= 3 and all(got[i] == min(j for j in range(n) if got[j] == got[i]) for i in range(n))
        assert all({got[k] for k in range(i, n, 5)} == {i} for i in apart)
        moved[n] = sum(seen)
    assert moved[1600] <= 8 * moved[400], moved


def test_bands_find_sets_whatever_the_number_of_sets():
    """30 keys a set; of 1000 pairs at the limit hardly one shares none, and each is shared with the similarity to the power of six."""
    rng, shared, missed = np.random.default_rng(3), 0, 0
    for _ in range(1000):
        own = rng.integers(-(2**63), 2**63 - 1, 110)
        same = simhash.bands(np.sort(own[:90])) == simhash.bands(np.sort(np.r_[own[:80], own[90:100]]))  # 80 of 100
        shared, missed = shared + same.mean(), missed + (not same.any())
    assert len(same) == simhash.BANDS and missed <= 2 and abs(shared / 1000 - 0.8**6) < 0.02
    assert len(simhash.bands(np.zeros(0, np.int64))) == 0


def test_large_groups_send_no_rows_of_counts_to_the_driver(spark, monkeypatch):
    """The shingles' counts of a group of several components come as Arrow columns, not as a million rows of Python."""
    rng, arrow = random.Random(9), []
    bases = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(3)]
    texts = [" ".join([*bases[i % 3][:40], f"x{i}", *bases[i % 3][40:]]) for i in range(60)]
    kind, plain = type(spark.range(1)), type(spark.range(1)).toArrow
    monkeypatch.setattr(simhash, "CELL", 8)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("rows of Python on the driver"))
    monkeypatch.setattr(kind, "toArrow", lambda self: arrow.append(1) or plain(self))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, texts), keys=[[]], most=128).collect()}
    assert arrow and got == {i: i % 3 for i in range(60)}


def test_tables_of_more_than_a_few_rows_are_joined_by_sorting(spark, monkeypatch, capsys):
    from emberwatch.llm import common

    monkeypatch.setattr(common, "FEW", 5)
    for n, way, other in ((5, "BroadcastHashJoin", "SortMergeJoin"), (6, "SortMergeJoin", "Broadcast")):
        spark.range(100).toDF("k").join(common.few(spark.range(n).toDF("k")), "k").explain()
        plan = capsys.readouterr().out
        assert way in plan and other not in plan
