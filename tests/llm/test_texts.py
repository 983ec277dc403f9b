import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberwatch.llm import common, decontam, langid, license_scan, pii, quality


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in re.finditer(p, text or "") if valid(k, m[0]))


def test_pii_base_spans(spark):
    rng = random.Random(9)
    parts = ["a@b.co", "a@b.cd%x@y.z", "q..a@b-c.d.e.", "@x.y", "1.2.3.4.5.6.7.8", "0255.1.01.1", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (743) 555-3824", "+12 34", "é𝒳", "😀", " ", "\n", ".", "-", "+", "9", "@", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "a" * 5000 + "@b.c", "a.b@" * 500 + "q.c"]
    got = pii.analyse(docs(spark, texts, terms="x", email="y", mentions=1)).select("doc_id", pii.span_text(pii.KINDS).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["s"] == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_long_runs_are_read_in_one_go(spark):
    texts = ["1" * 100_000, "1." * 50_000, "x@" * 30_000, "+1" + "2 " * 50_000, "a" * 200_000]
    assert pii.analyse(docs(spark, texts)).count() == 5


def brute_disclosures(texts, generalise, remove, support=2, reach=64):
    """Spans (text, start, end, action) by plain loops; settings are told apart by xxhash as Spark seeds it."""
    import math

    def h(*parts):
        out = 42
        for x in parts:
            if x is not None:
                out = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x, out & (2**64 - 1))
        return out - 2**64 if out >= 2**63 else out

    as_int = lambda v: (v & 0xFFFFFFFF).to_bytes(4, "little")
    as_long = lambda v: (v & (2**64 - 1)).to_bytes(8, "little")
    term = re.compile(r"[^\W\d_]{3,}")
    distinct = sorted(set(texts))
    with_term, settings, near = {}, {}, {}
    for t in distinct:
        for w in set(term.findall(t.lower())):
            with_term[w] = with_term.get(w, 0) + 1
        for m in re.finditer(KINDS[0][1], t):
            a, b = m.span()
            lo, hi = max(0, a - reach), min(len(t), b + reach)
            own = [x for x in term.finditer(t) if (lo == 0 or x.start() > lo or not t[lo - 1].isalpha()) and x.start() >= lo and (x.end() <= a or x.start() >= b) and x.end() <= hi]
            words = [x[0].lower() for x in own]
            pairs = [h(x, y) for x, y in zip(words, words[1:], strict=False)] if len(words) > 1 else [h(words[0])] if words else [0]
            setting = tuple(min(h(as_long(p), as_int(k)) for p in pairs) for k in range(pii.SKETCHES))
            settings.setdefault(m[0], set()).add(setting)
            for w in words:
                near.setdefault((m[0], w), set()).add(setting)
    number = lambda own: sorted(len({s[k] for s in own}) for k in range(pii.SKETCHES))[pii.COUNTED - 1]
    want, n = set(), len(distinct)
    for (e, w), own in near.items():
        both, with_entity = number(own), number(settings[e])
        if both >= support and with_entity < n:
            ratio = math.log(n * both / (with_term[w] * with_entity)) / math.log(n / with_entity)
            if ratio >= generalise:
                want |= {(d, x.start(), x.end(), "remove" if ratio >= remove else "generalise") for d, t in enumerate(texts) if e in re.findall(KINDS[0][1].replace("(", "(?:"), t) for x in term.finditer(t) if x[0].lower() == w}
    return want


def test_pii_disclosure_against_brute_force(spark):
    """Planted nicknames that stand with their address in different settings are found; other words aren't."""
    rng = random.Random(2)
    common_words = ["the", "and", "office", "meeting", "report", "harbour", "table", "river"]
    texts = []
    for k in range(80):
        who = f"p{k % 6}@mail.example"
        near = [f"nick{'abcdef'[k % 6]}"] * (k % 6 < 3) + rng.choices(common_words, k=6)
        texts.append(" ".join([*near[:4], who, *near[4:]]) if k % 2 else " ".join(rng.choices(common_words, k=5) + near))
    texts += texts[:20]
    got = {(r["doc_id"], t["start"], t["end"], t["action"]) for r in pii.analyse(docs(spark, texts), generalise=0.5, remove=0.95).collect() for t in r["terms"]}
    assert {"nickb"} == {texts[d][a:b] for d, a, b, _ in got}
    assert got == brute_disclosures(texts, 0.5, 0.95)


def test_planted_disclosures_are_found(spark):
    """A term that stands with its entity in two or more wholly different texts is found in at least 0.95 of all cases."""
    rng = random.Random(8)
    common = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(2000)]
    texts, planted = [], []
    for k in range(120):
        term, who = f"zz{''.join(rng.choices('nopqrst', k=8))}", f"q{k}@mail.example"
        planted.append(term)
        for _ in range(2 + k % 3):
            own = rng.choices(common, k=60)
            own[28:31] = [term, own[29], who]
            texts.append(" ".join(own))
    texts += [" ".join(rng.choices(common, k=60)) for _ in range(200)]
    found = {texts[r["doc_id"]][t["start"] : t["end"]] for r in pii.analyse(docs(spark, texts)).collect() for t in r["terms"]}
    assert len(found & set(planted)) >= 0.95 * len(planted) and len(found - set(planted)) <= 0.02 * len(common)


def test_a_text_of_many_spans(spark):
    """Forty thousand spans in one text, placed and replaced in time that grows with them, not with their square."""
    import time

    some = [f"naïve word{k % 50} u{k}@mail{k % 7}.example, 10.0.{k % 256}.{k % 255}" for k in range(20_000)]
    text = "; ".join(some)
    began = time.time()
    spans = pii.base_spans(docs(spark, [text])).select("email", "ip").first()
    assert [text[s["start"] : s["end"]] for s in spans["email"]] == [m[0] for m in re.finditer(r"u[0-9]+@mail[0-9]\.example", text)]
    assert len(spans["ip"]) == 20_000
    out = pii.sanitised(docs(spark, [text])).first()["text"]
    assert out.count("[EMAIL]") == out.count("[IP]") == 20_000 and "@" not in out
    assert time.time() - began < 120


def test_copies_alone_disclose_nothing(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts = []
    for k in range(30):
        own = [word() for _ in range(60)]
        own[30] = f"q{k}@mail.example"
        near = list(own)
        near[rng.choice([25, 29, 32, 50])] = word()
        texts += [" ".join(own)] * 3 + [" ".join(near)]
    found = pii.analyse(docs(spark, texts)).collect()
    assert len(found) == len(texts) and not any(r["terms"] for r in found)


def test_disclosing_terms_far_from_the_entity(spark):
    """A term that discloses an entity is found wherever the document repeats it, and only where the entity is held."""
    far = "and so on " * 40
    ways = ["write to nora@mail.example called Zebulon today", "our friend Zebulon answers at nora@mail.example soon", "ask (nora@mail.example) whether Zebulon came back"]
    texts = [f"{w} {far} zebulon {far} ZEBULON end" for w in ways] + [f"{far} nothing {k}" for k in range(40)] + [f"only zebulon {far}"]
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, texts)).collect()}
    assert all("zebulon" not in got[k].lower() and "[EMAIL]" in got[k] for k in range(3))
    assert got[43] == texts[43]
    spots = {r["doc_id"]: [(t["start"], t["end"]) for t in r["terms"]] for r in pii.analyse(docs(spark, texts)).collect()}
    assert {m.span() for m in re.finditer("zebulon", texts[0].lower())} <= set(spots[0]) and not spots[43]
    general = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, texts), remove=9.0).collect()}
    assert "called [NAME] today" in general[0] and " [WORD] " in general[0] and "[ACRONYM] end" in general[0]


def test_sanitised(spark):
    df = docs(spark, ["call +49 30 1234567 or a@b.co", None, "clean", "x a@b.co1.2.3.4"], extra=1)
    rows = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert rows == {0: "call [PHONE] or [EMAIL]", 1: None, 2: "clean", 3: "x [EMAIL]"} or rows[3].startswith("x [EMAIL]")
    assert pii.sanitised(df).columns == df.columns
    assert pii.sanitised(df.filter("false")).count() == 0


def test_numbers_inside_matches_that_are_too_long(spark):
    texts = ["x 4111111111111111 4012888888881881 y", "+1 (826) 555-4081 190.137.223.204", "1" * 40, "4111111111111111 4111111111111112"]
    got = {r["doc_id"]: r["s"] for r in pii.analyse(docs(spark, texts)).select("doc_id", pii.span_text((*pii.KINDS, "extra")).alias("s")).collect()}
    assert got == {0: "extra:2:18,extra:19:35", 1: "ip:18:33,extra:0:21", 2: "", 3: "extra:0:16"}
    assert {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, texts)).collect()} == {0: "x [CARD] [CARD] y", 1: "[PHONE]", 2: texts[2], 3: "[CARD] 4111111111111112"}


WORD, LOWER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_license_scan(spark):
    """Against plain loops over all blocks and templates."""
    rng = random.Random(6)
    whole = [t for own in license_scan.TEMPLATES.values() for t in own]
    pool = sorted({w for t in whole for w in WORD.findall(t.translate(LOWER))}) + ["filler"] * 60
    texts = ["MIT license mit License GENERAL public license", None, "", "İ K mit lİcense apache\nlicense", "x " * 900 + "released under the mit license"]
    texts += [" ".join(rng.choices(pool, k=rng.randint(0, 400))) for _ in range(40)]
    texts += [" ".join([*rng.choices(pool, k=20), *[w for w in t.split() if rng.random() < keep]]) for t in whole for keep in (1, 0.95, 0.85, 0.7)]
    texts.append(texts[-1])
    for r in license_scan.scan(docs(spark, texts, words="q", block=1, step=2, seen=3)).collect():
        w = WORD.findall((texts[r["doc_id"]] or "").translate(LOWER))
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        assert (r["n_words"], sorted(r["starts"]), r["base"]) == (len(w), sorted(starts), sorted(labels))
        best = 1.0 if labels else 0.0
        for label, own in license_scan.TEMPLATES.items():
            for text in own:
                parts = WORD.findall(text.translate(LOWER))
                step = max(8, 2 ** math.ceil(math.log2(len(parts))))
                for a in range(0, max(1, len(w)), step):
                    share = len(set(w[a : a + 2 * step]) & set(parts)) / len(set(parts))
                    if share >= (0.8 if len(set(parts)) >= 15 else 1):
                        labels.add(label)
                        best = max(best, share)
        assert r["labels"] == sorted(labels) and abs(r["score"] - best) < 1e-9
    assert license_scan.scan(docs(spark, ["a"]).filter("false")).count() == 0


def test_licenses_by_construction(spark):
    """Labels known from how the texts were made, not from the templates' definition."""
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choices("we went over the hill and saw that this year a new house is in the town with all of its doors open for use".split(), k=n))
    rows = []
    for label, own in license_scan.TEMPLATES.items():
        for t in own:
            words = t.split()
            rows.append((f"{filler(300)} {' '.join(words)} {filler(300)}", {label}))
            rows.append(("/* " + "\n * ".join(words) + " */", {label}))
            if len(words) > 30:  # a few words changed
                rows.append((" ".join(w if rng.random() > 0.05 else "changed" for w in words), {label}))
    nothing = ["The album was released in May; the band plays under a broad license deal.", "Released under the BSD license", "All rights reserved. No part may be copied without permission.", filler(2000)]
    nothing += ["This software is provided for your use. The source code may be found in the distribution, and the terms of use are subject to change without notice.", "He had a license to drive, and the public was free to use the road for any purpose."]
    rows += [(t, set()) for t in nothing] + [("released under the Apache license", {"apache"}), ("Released under the MIT license", {"mit"})]
    got = {r["doc_id"]: set(r["labels"]) for r in license_scan.scan(docs(spark, [t for t, _ in rows])).collect()}
    for k, (text, want) in enumerate(rows):
        assert got[k] == want, (text[:200], got[k], want)


LANGUAGES = {"aa": "ba be bi bo bu".split(), "bb": "xra xre xri xro".split(), "cc": "öl äl ül ßl".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(LANGUAGES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_langid(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang := rng.choice(list(LANGUAGES)), rng.randint(3, 60)), lang if i % 9 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, learn=F.col("doc_id") % 3 != 1, slots_log2=14)
    assert model.languages == ("aa", "bb", "cc")
    asked = df.filter("doc_id % 3 = 1").unionByName(spark.createDataFrame([(9001, None, "aa"), (9002, "12 !?", "aa"), (9003, "", None), (9004, "漢字", None)], df.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    right = [got[i][0] == lang for i, _, lang in rows if i % 3 == 1 and lang]
    assert sum(right) / len(right) > 0.97 and all(0 <= s <= 1 for _, s in got.values())
    assert got[9001] == got[9002] == got[9003] == ("und", 0.0) and got[9004][1] == 0.0
    nothing = langid.fit(df.filter("false"), learn=F.lit(True), slots_log2=10)
    assert nothing("ba") == ("und", 0.0)


def test_langid_by_sets(spark):
    """Against plain sets of n-grams per language; n-grams are letters with a blank at either end of a word."""
    rng = random.Random(18)
    rows = [(i, prose(rng, lang := rng.choice(list(LANGUAGES)), rng.randint(3, 60)), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, learn=F.lit(True), slots_log2=20)

    def grams(text):
        return [w[i : i + n] for x in re.findall(r"[^\W\d_]+", text.lower()) for w in [f" {x} "] for n in langid.SIZES for i in range(len(w) - n + 1)]

    known = {}
    for lang in LANGUAGES:
        own = [set(grams(t)) for _, t, x in rows if x == lang]
        counts = collections.Counter(g for s in own for g in s)
        known[lang] = {g for g, n in counts.items() if n >= max(1, 0.02 * len(own))}
    for r in langid.predict(df, model).collect():
        hits = {x: sum(g in own for g in grams(rows[r["doc_id"]][1])) for x, own in known.items()}
        top = sorted(hits.values(), reverse=True)
        assert r["lang_pred"] == min(hits, key=lambda x: (-hits[x], x)) and abs(r["score"] - top[0] / (top[0] + top[1])) < 0.02


def test_more_than_64_languages_and_a_text_that_fills_one(spark):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 6)]
    rows = [(k * 10 + j, " ".join("".join(rng.choices(letters[6 * k : 6 * k + 6], k=4)) for _ in range(20)), f"l{k:02}") for k in range(70) for j in range(6)]
    rows += [(10_000 + j, "zzz yyy xxx zzyyxx", "one") for j in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"key": F.lit(1), "learn": F.lit(False)})
    model = langid.fit(df, learn=F.lit(True), rows_per_language=50, slots_log2=16)
    assert len(model.languages) == 71 and model.words.shape[0] == 2
    assert all(model(t)[0] == x for _, t, x in rows[:430])


def test_bit_sliced_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    words = np.zeros(1 << 12, np.uint64)
    grams = rng.integers(0, 2**63, 300).astype(np.uint64)
    for at in langid._slots(grams, len(words)):
        words[at] |= np.uint64(4)
    assert (langid._lookup(words, grams) & np.uint64(4)).all()


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "sea", "calm", "bird", "flies", "over"]) for _ in range(rng.randint(5, 60))) + "."
    junk = lambda: " ".join(rng.choice(["BUY", "now$$$", "###", "free***"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, good() if i % 4 else junk(), int(i % 4 > 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = df.select("doc_id", F.col("y").alias("quality")).unionByName(spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int"))
    model = quality.fit(df, labels, learn=common.crc_mod(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: r["score"] for r in quality.scores(df, model).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows]
    assert sum(right) / len(right) > 0.98 and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_good(df.withColumn("a b", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "y", "a b"] and 300 < kept.count() < 450
    odd = quality.scores(docs(spark, [None, "", "x" * 200_000]), model).collect()
    assert len(odd) == 3 and odd[0]["score"] == odd[1]["score"]
    assert quality.fit(df, labels.filter("false"), learn=F.lit(True)).constant == 0.5
    assert quality.fit(df, labels.filter("quality = 1"), learn=F.lit(True)).constant == 1.0
    again = quality.fit(df, labels, learn=common.crc_mod(F.col("doc_id"), 5) != 0)
    assert np.array_equal(again.w1, model.w1)


def test_quality_by_plain_loops(spark):
    """Pooling and forward pass of the registered query's model, one word and one unit at a time."""
    from emberwatch.llm import queries

    folder = "/root/testdata/sf0.001"
    model = queries.quality_model(spark, folder)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(12).collect()
    scored = {r["doc_id"]: (r["score"], r["predicted"]) for r in queries.op6_quality(spark, folder).collect()}
    known = {w: k + quality.OTHER for k, w in enumerate(model.words)}
    for doc_id, text in rows:
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        ids = []
        for i, t in enumerate(tokens):
            own = known.get(t, 0 if len(t) > 1 and t.isupper() else 1 if t[0].isalnum() or t[0] == "_" else 2)
            ids.append(3 if t > "@" and t in tokens[max(0, i - 2) : i] and len(tokens) > 2 else own)
        x = []
        for d in range(model.vectors.shape[1]):
            x.append(sum(float(model.vectors[i][d]) for i in ids) / max(len(ids), 1))
        for d in range(model.vectors.shape[1]):
            x.append(math.sqrt(max(sum(float(model.vectors[i][d]) ** 2 for i in ids) / max(len(ids), 1) - x[d] ** 2, 0)))
        x.append(math.log1p(len(ids)))
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        z = model.b2
        for u in range(len(model.w2)):
            z += model.w2[u] * math.tanh(model.b1[u] + sum(v * model.w1[d][u] for d, v in enumerate(x)))
        want = 1 / (1 + math.exp(-z / model.temperature))
        assert abs(scored[doc_id][0] - want) < 1e-3 and scored[doc_id][1] == int(scored[doc_id][0] >= 0.3)


def edits(a, b):
    """Least edits of a against any piece of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 30, 8, 4, 1])] + [(None, ""), (9, None)]
    index = decontam.Index(items, q=6, window=40, errors=0.1)
    plain = ["".join(map(chr, decontam.normal(t)[0])) for _, t in items]
    for _ in range(60):
        k = rng.randrange(4)
        w, most, _ = index.limits[k]
        s = rng.randrange(len(plain[k]) - w + 1)
        piece = list(plain[k][s : s + w])
        for _ in range(rng.randint(0, 2 * most + 1)):
            p = rng.randrange(len(piece))
            piece[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
        text = f"{word()} {''.join(piece)}, {word()} {word()}"
        body = "".join(map(chr, decontam.normal(text)[0]))
        found = {m[0]: m for m in index.matches(text)}
        for i in range(4):
            w, most, _ = index.limits[i]
            least = min(edits(plain[i][a : a + w], body) for a in range(len(plain[i]) - w + 1))
            assert (i in found) == (least <= most), (i, least, most)
            if i in found:
                assert least <= found[i][1] <= most
    assert index.matches(None) == [] and index.matches("") == []


def test_decontamination_places_and_rows(spark):
    item = "Some benchmark question, about forty words long; what is the answer to it, then, and why would anyone ask for that?"
    benchmark = spark.createDataFrame([(7, item), (8, None), (None, "x")], "item_id long, text string")
    text = f"Prefix é. {item.upper()} Suffix"
    df = docs(spark, [text, "clean text", None, ""], item_id=3, edits=1)
    rows = decontam.contaminated(df, benchmark).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in rows] == [(0, 7, 0)]
    assert text[rows[0]["doc_start"] : rows[0]["doc_end"]].lower() in item.lower()
    kept = decontam.keep_clean(df, benchmark)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    short = spark.createDataFrame([(1, "Yes, no"), (2, "x"), (3, "?")], "item_id long, text string")
    asked = docs(spark, ["say yes  No!", "yesno", "yes nothing", "X", "axe", "no yes"])
    found = [(r["doc_id"], r["item_id"], r["doc_start"], r["doc_end"]) for r in decontam.contaminated(asked, short).collect()]
    assert sorted(found) == [(0, 1, 4, 11), (3, 2, 0, 1)]
    assert decontam.contaminated(df, benchmark.filter("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    items = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20)) for _ in range(12)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, [f"x {t} y" for t in items] + ["none"])
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, benchmark).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    parts = decontam.contaminated(df, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect()} == whole == {(i, i) for i in range(12)}
    assert decontam.keep_clean(df, benchmark).count() == 1


@pytest.mark.parametrize("text", [None, "", "a@b.co"])
def test_digest_of_spans(spark, text):
    r = pii.analyse(docs(spark, [text])).select(F.sha2(pii.span_text(pii.KINDS).cast("binary"), 256).alias("x")).first()
    assert r["x"] == hashlib.sha256(base(text).encode()).hexdigest()
