import base64
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import ann, chat, packing, warc
from emberwatch.llm.common import scratch


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_like_the_tokenizers(tokenizer):
    import public_tokenizers

    rng = random.Random(1)
    letters = list("abcdE 'sS.,!?1230\n\t\r\x0b\x0c\x1c\x85\xa0éÉßİΣσς中文٣²́​ <|>KⅧ½") + ["<|endoftext|>", "'s", "'RE", "n't", " 's", "ﬁ", "각"]
    own = packing._Ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None]
    for text, got in zip(texts, own.texts(texts, b""), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_ids_of_every_code_point(tokenizer):
    import public_tokenizers

    own = packing._Ids(public_tokenizers.path("word_bpe_49k.json"))
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    for k in range(0, len(points), 40_000):
        texts = [f"x{chr(c)}y" for c in points[k : k + 40_000]]
        want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert list(own.texts(texts, b"")) == want
    newer = "\ua7cb\ua7dc\u1c89\U00010d50"
    assert all(own.split(f"x{c}") is None for c in newer) and own.split("Éñß ok") is not None


def test_pieces_round_trip(spark, tokenizer):
    texts = [None, "", "hello world", "long " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(2, "hello world")], "doc_id long, text string").withColumn("shard", F.lit("x"))
    rows = packing.tokenised(df, with_ids=True).collect()
    for d, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted({(r["piece"], r["start"], tuple(r["ids"]), r["ids_crc32"]) for r in rows if r["doc_id"] == d})
        assert sum((list(x[2]) for x in own), []) == ids and [x[1] for x in own] == list(range(0, len(ids), 2048))
        assert all(x[3] == zlib.crc32(np.array(x[2], "<u4").tobytes()) for x in own)
    packed = packing.pack(packing.tokenised(df)).collect()
    assert len(packed) == len(rows)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.tokenised(df.filter("false"))).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"attention": 900_000}])
def test_best_fit_keeps_every_limit(by, limits):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 900, 600))[::-1]
    own = packing.Limits(by=by, **limits)
    bins, offsets = packing.best_fit(lengths, own)
    for b in np.unique(bins):
        n, at = lengths[bins == b], offsets[bins == b]
        assert n.sum() <= own.tokens and len(n) <= own.documents and (n * n).sum() <= own.attention
        assert at.tolist() == np.r_[0, np.cumsum(n)[:-1]].tolist()
    if not limits:
        assert bins.max() + 1 <= -(-lengths.sum() // 2048) + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3000]), own)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_against_all_open_bins(by):
    """Every choice is the best one over all bins, by plain loops."""
    rng = np.random.default_rng(9)
    limits = packing.Limits(by=by, documents=5, attention=1_500_000, weights=(1.0, 0.7, 0.4))
    lengths = np.sort(rng.integers(1, 1200, 500))[::-1]
    w = np.array(limits.weights) / np.array([limits.tokens, limits.documents, limits.attention])
    left, want = [], []
    for n in lengths.tolist():
        demand = np.array([n, 1, n * n])
        best = None
        for b, own in enumerate(left):
            if (own >= demand).all():
                score = -float((w * own) @ (w * demand)) if by == "dot" else float(((w * (own - demand)) ** 2).sum())
                if best is None or score < best[0]:
                    best = (score, b)
        if best is None:
            left.append(np.array([limits.tokens, limits.documents, limits.attention]))
        want.append(len(left) - 1 if best is None else best[1])
        left[want[-1]] = left[want[-1]] - demand
    assert packing.best_fit(lengths, limits)[0].tolist() == want


def test_best_fit_takes_the_fullest_bin():
    bins, _ = packing.best_fit(np.array([1500, 1000, 900, 500]), packing.Limits())
    assert bins.tolist() == [0, 1, 1, 0]


def turns(conv, texts, role="user"):
    return [(conv, i, role if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def brute_chat(rows):
    convs = {}
    for c, t, r, x in {(c, t, r or "", x or "") for c, t, r, x in rows}:
        convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    seqs = {c: tuple((r, x) for *_, r, x in sorted(v)) for c, v in convs.items()}
    kept = {c: s for c, s in seqs.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())}
    out = {}
    for s in set(kept.values()):
        own = [c for c in kept if kept[c] == s]
        named = [c for c in own if c is not None]
        out[min(named) if named else None] = (len(s), len(own), "".join(f"<|{r}|>\n{x}\n" for r, x in s))
    return out


def test_chat(spark):
    rng = random.Random(7)
    rows = turns(1, ["a", "b"]) + turns(2, ["a", "b", "c"]) + turns(3, ["a", "b", "c", "d"]) + turns(9, ["a", "b", "c", "d"]) + turns(4, ["a", "x"]) + turns(5, ["", None]) + turns(None, ["n"]) + turns(6, ["a", "b"], "system")
    rows += [(1, 0, "user", "a"), (7, 0, "us", "era"), (8, 0, "user", "a"), (10, None, None, None), (11, 0, "b", "2"), (11, 0, "a", "1")]
    for c in range(20, 90):
        rows += turns(c, [rng.choice("pq") for _ in range(rng.randint(1, 5))])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"h": F.lit(1), "prefixes": F.lit(2)})
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat.formatted(df).collect()}
    assert got == brute_chat(rows)
    assert chat.formatted(df.filter("false")).count() == 0


def vectors(rng, n, dims=24, centres=12):
    mid = rng.normal(size=(centres, dims))
    return (mid[rng.integers(0, centres, n)] + 0.6 * rng.normal(size=(n, dims))).astype(np.float32)


def brute_near(v, ids, asked, k=5):
    v = v.astype(float)
    norm = np.sqrt((v * v).sum(axis=1))
    out = {}
    for i in asked:
        s = (v * v[i]).sum(axis=1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 300)
    monkeypatch.setattr(ann, "QUERIES_PER_CELL", 7)
    rng = np.random.default_rng(5)
    v = vectors(rng, 3000)
    v[1000:1400] = v[1000]  # a hot vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, lists=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_near(v, np.arange(3000), range(0, 3000, 50))
    assert set(got) == set(want)
    hits = sum(len({x for _, x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q in want:
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert [x for _, x, _ in sorted(own, key=lambda y: (-y[2], y[1]))] == [x for _, x, _ in own]
        exact = dict(want[q])
        assert all(abs(exact[x] - s) < 1e-12 for _, x, s in own if x in exact)
    assert [x for _, x, _ in sorted(got[1000])] == [1001, 1002, 1003, 1004, 1005]


def test_ann_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, None), (100, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, -1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, x) for q, r, x, _ in got] == [(0, 1, 50), (0, 2, 8), (50, 1, 0), (50, 2, 8)]
    assert got[0][3] == 1.0
    assert ann.search(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    far = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1e300, -1e300]), (50, [3.0, 4.0, 0.0]), (51, [3.0, 4.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(far, F.col("vec_id") % 50 == 0).collect()}
    assert got.keys() == {(0, 1), (0, 2), (50, 51)} and abs(got[0, 1] - 0.5**0.5) < 1e-12 and abs(got[0, 2]) < 1e-12 and abs(got[50, 51] - 1) < 1e-12


def test_scan_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(1)
    v = vectors(rng, 2000, 64)
    x = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    ends = [8, 16, 32, 64]
    columns = [np.ascontiguousarray(x.T[a:b]) for a, b in zip([0, 8, 16, 32], ends, strict=True)]
    hits = 0
    for q in x[:100]:
        d = ((x - q) ** 2).sum(axis=1)
        hits += len(set(np.argsort(d, kind="stable")[:5]) & set(ann.scan(q, columns, ends, 5)))
    assert hits >= 490


def test_warc(spark):
    rows = [(None, None, None), (1, "a\r\nb", "x\r\n\r\nWARC/1.1\r\n"), (1, "a\r\nb", "x\r\n\r\nWARC/1.1\r\n"), (2, "u", "x\r\n\r\nWARC/1.1\r\n"), (3, None, ""), (None, "q", "é"), (9, "é", "long " * 10_000), (5, "é", "long " * 10_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "f": F.lit(2)})
    path = scratch(spark, "test-warc")
    got = warc.round_trip(df, path).collect()
    assert len(got) == len(rows) and all(r["request"] and r["metadata"] for r in got)
    groups = {}
    for p, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    want = []
    for data, pages in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        order = sorted(pages, key=lambda p: (p is None, p or 0))
        want += [(p, len(data), digest, "revisit" if i else "response") for i, p in enumerate(order)]
    key = lambda x: json.dumps(x)
    assert sorted([(r["metadata"]["page_id"], r["main"]["payload_bytes"], r["main"]["payload_digest"], r["main"]["kind"]) for r in got], key=key) == sorted(want, key=key)
    assert all((r["main"]["refers_to"] is None) == (r["main"]["kind"] == "response") for r in got)
    names = {r["record_id"] for r in got}
    assert len(names) == len(got) and all(r["main"]["refers_to"] in names for r in got if r["main"]["refers_to"])
    sizes = spark.createDataFrame([(k, "u", "x" * n) for k, n in enumerate([10, 70_000, 70_001, 1_200_000])], "page_id long, url string, html string")
    by_size = scratch(spark, "test-warc")
    assert sorted(r["main"]["payload_bytes"] for r in warc.round_trip(sizes, by_size).collect()) == [10, 70_000, 70_001, 1_200_000]
    with_payload = warc.read(spark, path, with_payload=True).filter("kind = 'response'").collect()
    assert {bytes(r["payload"]) for r in with_payload} == set(groups)
    small = warc.round_trip(df, scratch(spark, "test-warc"), least_bytes=17).collect()
    assert sorted(r["main"]["kind"] for r in small).count("revisit") == 1
    assert warc.round_trip(df.filter("false"), scratch(spark, "test-warc")).count() == 0


def test_warc_parser_takes_records_by_length():
    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert [b for _, b in warc.parse(one * 3)] == [block] * 3
    with pytest.raises(ValueError):
        list(warc.parse(b"x\r\n\r\n"))
