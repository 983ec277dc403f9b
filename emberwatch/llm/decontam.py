"""Benchmark decontamination by q-gram filtering over diagonal bands and banded alignment.

Texts are compared as lower-case letters and digits with single blanks between words. Two passages of
w characters within e edits share at least w + 1 - q(e + 1) q-grams (the q-gram lemma), all of them on
diagonals that differ by at most e. So shared q-grams are counted in overlapping bands of diagonals,
bands that reach the bound within one window keep their region, and a banded alignment decides.

A document is contaminated by an item if it holds a passage within e edits of some w characters of it;
w is `window`, or the item's length if that is smaller, and e is `errors` * w rounded down (less where
the bound would fall under one).

Items of fewer than q characters (as compared) have no q-gram; they are looked for as they stand, as whole words.

Defined cases: null and empty texts match nothing, nor do items without a letter or digit; repeated items and rows are reported each; null ids are reported as
null; an empty benchmark or table gives no rows; columns other than the id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, per_worker

Q, WINDOW, ERRORS = 10, 80, 0.0625
STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Characters of benchmark text that are sent to every task at a time; more of it goes in further blocks.
BLOCK_CHARS = 8_000_000


def _make_tables() -> tuple[np.ndarray, np.ndarray]:
    lower, keep = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum():
            keep[k] = True
            if len(x := c.lower()) == 1:
                lower[k] = ord(x)
    return lower, keep


def normal(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points as compared, and the place of each in the text."""
    lower, keep = per_worker("alnum", _make_tables)
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = keep[codes]
    gap = ~solid
    gap[1:] &= solid[:-1]
    if len(gap):
        gap[0] = False
    at = np.flatnonzero(solid | gap)
    if len(at) and not solid[at[-1]]:
        at = at[:-1]
    return np.where(solid[at], lower[codes[at]], np.uint32(32)), at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    m = len(codes) - q + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    wide, h = codes.astype(np.uint64), np.zeros(m, np.uint64)
    for k in range(q):
        h = (h ^ wide[k : k + m]) * STEP
    return (h ^ (h >> np.uint64(31))) * MIX


def limits(length: int, q: int, window: int, errors: float) -> tuple[int, int, int]:
    """Window, edits and least shared q-grams for an item of so many characters."""
    w = min(window, length)
    e = int(errors * w)
    while e and w + 1 - q * (e + 1) < 1:
        e -= 1
    return w, e, w + 1 - q * (e + 1)


def banded(item: np.ndarray, doc: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of item against a piece of doc that starts on a diagonal (doc minus item place) from first to last.

    Returns edits, start and end in doc, or None if more than `most` edits are needed."""
    lo, hi, far = first - most, last + most, most + 1
    width = hi - lo + 1
    cost, start = [0] * width, [lo + d for d in range(width)]
    a, b, n = item.tolist(), doc.tolist(), len(doc)
    for d in range(width):
        if not 0 <= lo + d <= n:
            cost[d] = far
    for r, x in enumerate(a):
        new, begun = [far] * width, [0] * width
        for d in range(width):
            j = r + 1 + lo + d  # characters of doc used
            if j < 0 or j > n:
                continue
            best, at = far, 0
            if j >= 1 and (c := cost[d] + (b[j - 1] != x)) < best:
                best, at = c, start[d]
            if d + 1 < width and (c := cost[d + 1] + 1) < best:
                best, at = c, start[d + 1]
            if d and j >= 1 and (c := new[d - 1] + 1) < best:
                best, at = c, begun[d - 1]
            new[d], begun[d] = best, at
        cost, start = new, begun
        if min(cost) > most:
            return None
    d = min(range(width), key=lambda k: (cost[k], k))
    return (cost[d], max(0, start[d]), len(a) + lo + d) if cost[d] <= most else None


class Index:
    """q-grams of benchmark items: a bit filter, and places by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], q: int = Q, window: int = WINDOW, errors: float = ERRORS) -> None:
        self.q, self.errors, self.ids = q, errors, [i for i, _ in items]
        self.codes = [normal(t)[0] for _, t in items]
        self.limits = [limits(len(c), q, window, errors) if len(c) >= q else (0, 0, 0) for c in self.codes]
        hashes = [grams(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])[order] if items else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if items else np.zeros(0, np.int64)
        self.bits = max(16, min(26, int(np.ceil(np.log2(max(1, len(flat)) * 32)))))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(flat >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.kinds = sorted({(w, t) for w, _, t in self.limits if w})
        self.short: dict[bytes, list[int]] = {}  # items of fewer than q characters
        for k, c in enumerate(self.codes):
            if 0 < len(c) < q:
                self.short.setdefault(c.tobytes(), []).append(k)
        self.short_words = {int((np.frombuffer(c, np.uint32) == 32).sum()) + 1 for c in self.short}

    def _dense(self, hit: np.ndarray) -> np.ndarray:
        """Hits in some window that has as many hits as some item of that window needs."""
        total, out = np.r_[0, np.cumsum(hit, dtype=np.int64)], np.zeros(len(hit), bool)
        if not self.kinds:
            return out
        for w, need in self.kinds:
            span = w + int(w * self.errors) - self.q + 2
            if total[-1] < need:
                continue
            upper = np.minimum(np.arange(len(hit)) + span, len(hit))
            full = np.flatnonzero(total[upper] - total[: len(hit)] >= need)
            if len(full):
                edge = np.zeros(len(hit) + 1, np.int64)
                np.add.at(edge, full, 1)
                np.add.at(edge, upper[full], -1)
                out |= np.cumsum(edge[:-1]) > 0
        return out & hit

    def matches(self, text: str | None) -> list[tuple]:
        """(item number, edits, start, end, item start, item length) of the best passage of each item found."""
        codes, at = normal(text)
        return self._short(codes, at) + self._long(codes, at)

    def _short(self, codes: np.ndarray, at: np.ndarray) -> list[tuple]:
        """The first place of each short item, whole words only."""
        if not self.short or not len(codes):
            return []
        gaps, out = np.flatnonzero(codes == 32), {}
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(codes)]
        for n in self.short_words:
            for a, b in zip(starts[: len(starts) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True):
                if b - a < self.q and (own := self.short.get(codes[a:b].tobytes())):
                    for k in own:
                        out.setdefault(k, (k, 0, int(at[a]), int(at[b - 1]) + 1, 0, b - a))
        return sorted(out.values())

    def _long(self, codes: np.ndarray, at: np.ndarray) -> list[tuple]:
        h = grams(codes, self.q)
        if not len(h) or not len(self.hash):
            return []
        hit = self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        i = np.flatnonzero(self._dense(hit))
        if not len(i):
            return []
        a, b = np.searchsorted(self.hash, h[i], "left"), np.searchsorted(self.hash, h[i], "right")
        n = b - a
        where = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        i, item, j = np.repeat(i, n), self.item[where], self.place[where]
        out = []
        for k in np.unique(item):
            own = item == k
            if (best := self._verify(codes, int(k), i[own], j[own])) is not None:
                e, s, t, js, jn = best
                out.append((int(k), e, int(at[s]), int(at[t - 1]) + 1, js, jn))
        return out

    def _verify(self, codes: np.ndarray, k: int, i: np.ndarray, j: np.ndarray):
        w, e, need = self.limits[k]
        own, step, best = self.codes[k], e + 1, None
        band = (i - j) // step
        for x in np.unique(np.r_[band, band - 1]):
            at = (band == x) | (band == x + 1)  # diagonals from x * step on, two steps wide
            bi, first = np.unique(i[at], return_index=True)
            bj = j[at][first]
            if len(bi) < need:
                continue
            reach = bi[need - 1 :] - bi[: len(bi) - need + 1] <= w + e - self.q
            tried = set()
            for p in np.flatnonzero(reach):
                ends = sorted((int(bj[p]), int(bj[p + need - 1])))
                low, high = max(0, ends[1] + self.q - w), min(ends[0], len(own) - w)
                for s in (high, (low + high) // 2, *range(low, high)) if low <= high else ():
                    if s in tried:
                        continue
                    tried.add(s)
                    found = banded_exact(own[s : s + w], codes, s + int(x) * step, s + (int(x) + 2) * step - 1, e)
                    if found and (best is None or found[0] < best[0]):
                        best = (*found, s, w)
                        if not best[0]:
                            return best
        return best


def banded_exact(item: np.ndarray, doc: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """banded(), with a plain comparison first: most passages are copied as they stand."""
    for d in range(max(0, first), last + 1):
        if d + len(item) <= len(doc) and np.array_equal(doc[d : d + len(item)], item):
            return 0, d, d + len(item)
    return banded(item, doc, first, last, most)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of bounded size; one block unless it is large."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, window: int = WINDOW, errors: float = ERRORS) -> DataFrame:
    """One row per document and item with a match: doc_id, item_id, edits, and the best passage's places in both texts."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, edits int, doc_start int, doc_end int, item_start int, item_chars int"
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(sent.value, q, window, errors)
            for pdf in batches:
                rows = [(d, index.ids[m[0]], *m[1:]) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True) for m in index.matches(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "doc_start", "doc_end", "item_start", "item_chars"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        one = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that match no item; columns as they are, whatever they are called.

    Null and empty texts match nothing and stay; each of repeated rows is judged for itself; very long texts
    are read whole; an empty benchmark keeps all rows, an empty table gives none.
    """
    kept, (hit,) = docs, free_names(docs, "hit")
    for items in _blocks(benchmark):
        kept = kept.withColumn(hit, _tester(docs, items, how)(F.col("text").cast("string"))).filter(~F.col(hit)).drop(hit)
    return kept


def _tester(docs: DataFrame, items: list, how: dict):
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(sent.value, **how)
        for texts in batches:
            yield pd.Series([bool(index.matches(t)) for t in texts], dtype=bool)

    return found
