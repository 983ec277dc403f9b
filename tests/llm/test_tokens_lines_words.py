"""Spelling variants, token alignment and line dedup, by plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import alignment, line_dedup, spelling

DOCS = "doc_id long, text string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)


# --- spelling variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w)))
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("group", [20_000, 3])
def test_variants_by_all_pairs(spark, group):
    """Words over few letters, so that most have neighbours, runs of equal letters and all lengths; small groups are split."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 7, 8, 9, 13]))) for _ in range(500)}
    words |= {"a" * n for n in range(6, 15)} | {"abcdefghij" * 30 + x for x in ("", "a", "b", "ab", "ba")}
    counts = {w: rng.choice([5, 6, 9, 30, 31, 200, 1000, 30_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df, group=group)) == plain_variants(counts)


def test_frequent_prefix_is_split(spark):
    """A third of all words begin alike; splitting them loses no pair, and no partition is above the bound."""
    rng = random.Random(4)
    words = {"prefixprefix" + "".join(rng.choice("abcd") for _ in range(12)) for _ in range(300)}
    words |= {w[:i] + rng.choice("abcd") + w[i + rng.choice([0, 1]) :] for w in list(words)[:150] for i in [rng.randrange(13, 24)]}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(df, group=20).collect()}
    assert got == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_counts_of_words(spark):
    texts = ["Straße STRASSE straßen", "naïveté×x abcdef7abcdef", None, "", "abcdeF " * 400 + "short"] * 3
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs(spark, texts), often=1, slip=7).collect()}
    want = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run
            if len(run) >= 6:
                want[run] += 1
    assert got == want


def test_words_of_a_million_letters(spark):
    long = "ab" * 200_000
    df = spark.createDataFrame([(long, 5), (long + "c", 100), ("x" + long[1:], 7)], "word string, n long")
    got = rows_of(spelling.variants(df))
    assert got[long] == (long + "c", long + "c", 5, 2, 100) and got[long + "c"][3] == 1


def test_no_words(spark):
    empty = docs(spark, []).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    assert spelling.variants(spelling.word_counts(docs(spark, [None, "", "a b c"]))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(empty), ratio=1)


# --- token alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    byte = {chr(k) if k in printed else chr(next(rest)): k for k in range(256)}
    left = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if i < 50256}
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    right = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    return a, b, left, right


def plain_alignment(texts, tokenizers, kind="end"):
    a, b, left, right = tokenizers
    found, counts = [], Counter()
    for text in texts:
        ids = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spans = []
        for own, table in zip(ids, (left, right), strict=True):
            end, some = 0, []
            for i in own:
                some.append((i, end, end := end + len(table[i])))
            spans.append(some)
        if not text or any(b"".join(table[i] for i in own) != f" {text}".encode() for own, table in zip(ids, (left, right), strict=True)):
            found.append(None)
            continue
        shared = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        group = [[sum(e < s[2] for e in shared) for s in side] for side in spans]
        written = ";".join("|".join(",".join(str(s[0]) for s, k in zip(side, of, strict=True) if k == g) for side, of in zip(spans, group, strict=True)) for g in range(len(shared)))
        test = {"end": lambda x, y, g, h: x[2] == y[2], "overlap": lambda x, y, g, h: x[1] < y[2] and y[1] < x[2], "group": lambda x, y, g, h: g == h}[kind]
        links = [(x[0], y[0]) for x, g in zip(spans[0], group[0], strict=True) for y, h in zip(spans[1], group[1], strict=True) if test(x, y, g, h)]
        counts.update(links)
        found.append((len(ids[0]), len(ids[1]), len(shared), links, hashlib.sha256(written.encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(0,) * 6 + ("",) if x is None else (*x[:3], len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in found]


TEXTS = [
    "The quick brown fox jumps over the lazy dog, 12345 times!",
    " leading  and   many    blanks \n\t tabs\nlines \n",
    "",
    None,
    "<|endoftext|> <s> </s> <unk> are plain",
    "Größenwahn naïve 漢字かな交じり文 🙂🙂 é   　x",
    "literal ▁ piece",
    "a▁ b",
    "tail blank ",
    " ",
    "  ",
    "don't they'll I'M O'Neill",
    "x" * 3000,
    "zero\x00byte \x1c sep \x85 nel",
    "The quick brown fox jumps over the lazy dog, 12345 times!",
]


@pytest.mark.parametrize("kind", alignment.KINDS)
def test_alignment_by_definition(spark, tokenizers, monkeypatch, kind):
    monkeypatch.setattr(alignment, "BLOCK", 150)
    texts = [t if len(t or "") < 500 or kind != "group" else t[:50] for t in TEXTS]
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align_tokens(docs(spark, texts), links=kind).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts, tokenizers, kind)


def test_stretches_are_cut_where_no_token_crosses(tokenizers):
    """Random text of blanks, letters and marks: ids of the stretches in a row are those of the whole text."""
    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice("  \n\t ab'sé1., 漢\x1c") for _ in range(rng.randrange(1, 40)))
        own = pair.stretches(text)
        assert "".join(own) == f" {text}" and pair.cuts
        assert [i for s in own for i in pair.a.encode_ordinary(s)] == tokenizers[0].encode(f" {text}", add_special_tokens=False).ids
        assert [i for s in own for i in (pair.b.encode(s[1:]) if s != " " else [pair.space])] == tokenizers[1].encode(text)


def test_elementary_intervals():
    a, b, shared = alignment.elementary(np.array([3, 5, 9]), np.array([2, 5, 6, 9]))
    assert list(zip(a.tolist(), b.tolist(), shared.tolist(), strict=True)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (2, 3, True)]
    left, right = alignment.group_products(np.array([0, 0, 1]), np.array([0, 0, 1, 1]))
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)]


def test_alignment_of_nothing_and_of_long_texts(spark, tokenizers):
    assert alignment.align_tokens(docs(spark, [])).count() == 0
    text = "word and another word, " * 60_000
    got = alignment.align_tokens(docs(spark, [text, None])).orderBy("doc_id").collect()
    assert got[0]["n_a"] == len(tokenizers[0].encode(f" {text}", add_special_tokens=False).ids) and tuple(got[1])[1:] == (0,) * 6 + ("",)
    with pytest.raises(ValueError):
        alignment.align_tokens(docs(spark, []), links="none")


# --- line dedup


def plain_lines(rows, min_docs, min_chars=1, keep="none"):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    seen = defaultdict(set)
    for row in set(rows):
        for line in (row[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen[key(line)].add(row)
    order = lambda row: (row[0] is not None, row[0] or 0)
    out = []
    for row in rows:
        lines, kept, had = (row[1] or "").split("\n"), [], set()
        for line in lines:
            k = key(line)
            drop = len(seen.get(k, ())) >= min_docs
            if drop and keep == "first" and min(seen[k], key=order) == row and k not in had:
                drop = False
            had.add(k)
            if not drop:
                kept.append(line)
        out.append((row[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got_lines(df, **how):
    return sorted((tuple(r) for r in line_dedup.applied(df, line_dedup.keep_bitmaps(df, **how)).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def many_lines():
    rng = random.Random(9)
    pool = [f"{'A' * (k % 3)}Line {k}" for k in range(60)] + ["", " ", "é", "É", "\t x \r"]
    rows = [(i, "\n".join(rng.choice(pool[: rng.choice([5, 65])]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(12)))) for i in range(150)]
    return [*rows, (500, None), (501, ""), (502, "\n"), (503, "alone"), *[rows[0]] * 20]


@pytest.mark.parametrize("keep", line_dedup.MODES)
@pytest.mark.parametrize("min_docs", [1, 2, 10, 60])
def test_lines_by_definition(spark, keep, min_docs):
    """Lines in one or all documents, repeated rows, blank lines; hot lines cross the tasks' edges."""
    rows = many_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = got_lines(df, min_docs=min_docs, keep=keep)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(plain_lines(rows, min_docs, keep=keep), key=str)


def test_a_hot_line_is_spread_over_tasks(spark):
    rows = [(i, f"everywhere\nline {i}\nEverywhere ") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    lines = line_dedup._lines(df, 1)
    order = ["h1", "h2", "doc_id", "d1", "d2"]
    parts = lines.repartitionByRange(16, *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 8000 / 5
    assert got_lines(df, min_docs=10) == sorted(((i, 3, 2, f"line {i}") for i in range(4000)), key=str)


def test_line_options_and_clashing_names(spark):
    rows = [(i, "x\nlonger line\né1", "a", "b") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, D1 string, bits string")
    out = line_dedup.applied(df, line_dedup.keep_bitmaps(df, min_chars=3))
    assert out.columns[:4] == ["doc_id", "text", "D1", "bits"]
    assert {tuple(r)[1:] for r in out.collect()} == {("x\nlonger line\né1", "a", "b", 3, 1, "x\né1")}
    assert got_lines(spark.createDataFrame([], "doc_id long, text string")) == []
    ids = spark.createDataFrame([("b", "same"), ("a", "same"), (None, "own")], "doc_id string, text string")
    assert got_lines(ids, min_docs=2, keep="first") == [("a", 1, 0, "same"), ("b", 1, 1, ""), (None, 1, 0, "own")]
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(df, keep="all")


def test_long_text_of_lines(spark):
    text = "\n".join(f"l{k % 70_000}" for k in range(200_000))
    df = spark.createDataFrame([(i, text[: len(text) - i]) for i in range(3)], "doc_id long, text string")
    assert got_lines(df, min_docs=3)[0][1:3] == (200_000, 200_000)
