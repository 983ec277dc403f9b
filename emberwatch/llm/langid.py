"""Language identification by n-gram filters whose every slot is a bitmask of languages.

A bit-sliced Bloom filter keeps language bits per slot, in as many 64-bit words as the languages take; ANDing
an n-gram's slots gives all languages that (may) contain it at once. Per language the hits of a text are counted
and corrected for that language's false positives; the largest count decides.

Defined cases: null text or text without a letter gives `und` with score 0; ties go to the language
whose name sorts first; a text none of whose n-grams is known gets the most frequent language with score 0;
no training rows at all give `und`; of repeated texts of a language one is learned from, so a text that makes up
most of a language neither fills the sample nor misses it; an empty table gives no rows; columns other
than those named are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_worker

SIZES = (2, 3, 4)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def _make_tables() -> tuple[np.ndarray, np.ndarray]:
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            letter[k] = True
            if len(x := c.lower()) == 1:
                lower[k] = ord(x)
    return lower, letter


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter tests of every code point."""
    return per_worker("letters", _make_tables)


def _ngrams(text: str) -> np.ndarray:
    """Hashes of a text's n-grams; all but letters are spaces, and no n-gram reaches over one."""
    lower, letter = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[codes]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(is_letter, lower[codes], 32).astype(np.uint64)
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    letters, out = codes != 32, []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h, inner = np.full(m, n, np.uint64), np.ones(m, bool)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * STEP
            if 0 < k < n - 1:
                inner &= letters[k : k + m]
        inner &= letters[:m] | letters[n - 1 : n - 1 + m]
        out.append(((h ^ (h >> np.uint64(29))) * MIX)[inner])
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: np.ndarray  # words of language bits x slots
    false: np.ndarray  # false-positive rate of each language
    usual: int  # index of the most frequent language

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams = _ngrams(text or "")
        if not len(grams) or not self.languages:
            return "und", 0.0
        masks = [_lookup(w, grams) for w in self.words]
        hits = np.array([np.count_nonzero(masks[k >> 6] & np.uint64(1 << (k & 63))) for k in range(len(self.languages))], float)
        true = np.maximum(hits - len(grams) * self.false, 0) / np.maximum(1 - self.false, 1e-9)
        order = np.argsort(-true, kind="stable")
        best = true[order[0]]
        if best <= 0:
            return self.languages[self.usual], 0.0
        second = true[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(best / (best + second))


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    shift = np.uint64(64 - int(size).bit_length() + 1)
    return [((grams * c) >> shift).astype(np.int64) for c in ODD]


def _lookup(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    a, b, c = _slots(grams, len(words))
    return words[a] & words[b] & words[c]


def fit(docs: DataFrame, *, learn: Column, rows_per_language: int = 1500, least: float = 0.02, slots_log2: int = 21) -> Model:
    """Learns from rows where `learn` holds and lang isn't null, from every language there is.

    rows_per_language bounds the sample: about so many distinct texts of each language, chosen by a hash of the text
    (all, if a language has fewer); an n-gram belongs to a language if it is in at least `least` of that language's
    sampled texts, which also bounds what reaches the driver.
    """
    none = Model((), np.zeros((1, 1 << slots_log2), np.uint64), np.zeros(0), 0)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), learn.alias("learn")).filter("learn and lang is not null and text is not null")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("key"))
    sizes = {r["lang"]: (r["n"], r["rows"]) for r in rows.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("rows")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).collect()}
    names = tuple(sorted(sizes))
    if not names:
        return none
    share = F.create_map(*[F.lit(x) for k, (n, _) in sizes.items() for x in (k, rows_per_language / n)])
    sample = rows.filter((F.pmod("key", F.lit(1_000_003)) / F.lit(1_000_003.0)) < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "key"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                grams, n = np.unique(np.concatenate([np.unique(_ngrams(t)) for t in own["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})
                yield pd.DataFrame({"lang": [lang], "gram": [None], "n": [len(own)]}).astype({"gram": "Int64"})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.filter("gram is null").collect()}
    if not totals:
        return none
    floor = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, max(1.0, least * n))])
    kept = counts.filter(F.col("gram").isNotNull() & (F.col("n") >= F.element_at(floor, F.col("lang")))).select("lang", "gram").toPandas()
    words = np.zeros((-(-len(names) // 64), 1 << slots_log2), np.uint64)
    for k, name in enumerate(names):
        grams = kept.loc[kept["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in _slots(grams, words.shape[1]):
            words[k >> 6, at] |= np.uint64(1 << (k & 63))
    filled = np.array([np.count_nonzero(words[k >> 6] & np.uint64(1 << (k & 63))) for k in range(len(names))]) / words.shape[1]
    return Model(names, words, filled ** len(ODD), names.index(max(sizes, key=lambda k: (sizes[k][1], k))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the two best languages' hits that the best has) of every row; only text is used."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.false, model.usual))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for pdf in batches:
            said = [own(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x for x, _ in said], "score": [float(x) for _, x in said]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double")
