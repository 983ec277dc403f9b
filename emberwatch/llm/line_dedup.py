"""Line dedup: lines that many documents share, dropped by bitmaps of the lines that each document keeps.

Of every document, each distinct line's hash goes out once with its places. The hashes are range-partitioned and sorted by document, the
document being part of the range, so that a line that a third of all documents have is spread over many tasks. Each task
streams its runs of equal hashes and holds back no more of a run than it needs to decide it. Only the first and last run of
a task may go on elsewhere: their counts are added up, two rows a task at most, and decide what was held back. What comes back is one
compressed bitmap per document that loses lines; texts are only cut when that is joined to them.

Defined cases: a null or empty text is one empty line. Rows that agree in doc_id and text are one document and get the same bitmap, also
if doc_id is null; rows that share only a doc_id are documents of their own. Lines shorter than min_chars are always kept. An empty table
gives no rows. Other columns are kept, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names

BLANK = b" \t\n\x0b\x0c\r"
MODES = ("none", "first")


def _document(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that name a document by its doc_id and text."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text"))


def keys(raw: bytes) -> list[bytes]:
    """Each line's key: no white space at the ends, A-Z lower-cased."""
    return [line.strip(BLANK) for line in raw.lower().split(b"\n")]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, d1, d2, n_lines, at): the places of each distinct line of each document."""
    names, types = ["h1", "h2", "doc_id", "d1", "d2", "n_lines", "at"], [pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, of, sizes, places = [], [], [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                if not raw:
                    continue
                own, at = keys(raw), defaultdict(list)
                for k, key in enumerate(own):
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        at[key].append(k)
                digests += map(xxhash.xxh3_128_digest, at)
                of += [i] * len(at)
                sizes += [len(own)] * len(at)
                places += at.values()
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            docs_of = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(3)]
            columns = [h[:, 0], h[:, 1], *docs_of, sizes, places]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    d1, d2 = _document(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.select("doc_id", d1.alias("d1"), d2.alias("d2"), F.col("text").cast("string").cast("binary").alias("text"))
    return sent.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, d1 long, d2 long, n_lines int, at array<int>")


RUNS = "h1 long, h2 long, d1 long, d2 long, n_lines int, at array<int>, sure boolean, docs long, part long"
RUN_TYPES = [*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.int64()]


class Runs:
    """The runs of equal hashes of one task, in order: which places are dropped, or what must be known to tell.

    Rows with `docs` say how many documents of a run at the task's edge are here, and which is its first.
    """

    def __init__(self, min_docs: int, keep: str, part: int) -> None:
        self.min_docs, self.keep, self.part = min_docs, keep, part
        self.hash, self.first, self.n, self.lead, self.last, self.held, self.out = None, True, 0, None, None, [], []

    def add(self, key: tuple[int, int], rows: Iterator[tuple]) -> None:
        """rows: (d1, d2, n_lines, at), in order of documents; repeated documents count once."""
        if key != self.hash:
            self.close(edge=self.first)
            self.first = self.hash is None
            self.hash, self.n, self.last, self.held = key, 0, None, []
        for row in rows:
            if row[:2] == self.last:
                continue
            self.last = row[:2]
            self.n += 1
            if self.n == 1:
                self.lead = row[:2]
            self.held.append(row)
            if self.n >= self.min_docs:
                for held in self.held:
                    self._decided(held)
                self.held = []

    def _decided(self, row: tuple) -> None:
        if self.keep == "none" or row[:2] != self.lead:
            self.out.append((*self.hash, *row, True, None, None))
        elif self.first:  # it may go on from an earlier task
            self.out.append((*self.hash, *row, False, None, None))
        elif len(row[3]) > 1:
            self.out.append((*self.hash, *row[:3], row[3][1:], True, None, None))

    def close(self, edge: bool) -> None:
        if self.hash is None or not edge:
            return
        self.out += [(*self.hash, *row, False, None, None) for row in self.held]
        self.out.append((*self.hash, *self.lead, None, None, None, self.n, self.part))

    def taken(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out, strict=True)) or [()] * len(RUN_TYPES), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RUN_TYPES, strict=True)], [x.split()[0] for x in RUNS.split(", ")])


def _streamed(lines: DataFrame, min_docs: int, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(min_docs, keep, TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            sizes = np.diff(np.r_[starts, batch.num_rows])
            # runs of one row inside the batch are lines of one document
            asked = (sizes > 1) | (min_docs <= 1)
            asked[[0, -1]] = True
            rows = batch.take(pa.array(np.flatnonzero(np.repeat(asked, sizes))))
            rows = zip(*[rows.column(k).to_pylist() for k in (3, 4, 5, 6)], strict=True)
            for k in np.flatnonzero(asked).tolist():
                runs.add((int(h1[starts[k]]), int(h2[starts[k]])), (next(rows) for _ in range(sizes[k])))
            yield runs.taken()
        runs.close(edge=True)
        yield runs.taken()

    return lines.mapInArrow(run, RUNS)


@F.pandas_udf(T.StructType().add("n_dropped", T.LongType()).add("keep", T.BinaryType()))
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    out = []
    for n, places in zip(n_lines, dropped, strict=True):
        bits = np.ones(n, np.uint8)
        bits[places] = 0
        out.append((n - int(bits.sum()), zlib.compress(np.packbits(bits).tobytes(), 1)))
    return pd.DataFrame(out, columns=["n_dropped", "keep"])


def kept_lines(lines: list[str], keep: bytes) -> list[str]:
    return list(compress(lines, np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()))


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(d1, d2, n_lines, n_dropped, keep) of each document that loses lines.

    Lines found in at least min_docs documents go; with keep="first" their first occurrence, by doc_id and place, stays.
    keep is a bit per line (1: kept), eight to a byte, compressed by zlib.
    """
    if keep not in MODES:
        raise ValueError(f"keep: one of {MODES}")
    order = ["h1", "h2", "doc_id", "d1", "d2"]
    lines = _lines(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = cut(_streamed(lines, min_docs, keep))
    # two rows a task at most
    edges = runs.filter("docs is not null").groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.min_by(F.struct("d1", "d2"), "part").alias("lead"))
    unsure = runs.filter("not sure").join(F.broadcast(edges), ["h1", "h2"]).filter(F.col("n") >= min_docs)
    at = F.col("at")
    if keep == "first":
        at = F.when((F.col("lead.d1") == F.col("d1")) & (F.col("lead.d2") == F.col("d2")), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(at)
    drops = runs.filter("sure").select("d1", "d2", "n_lines", "at").unionByName(unsure.select("d1", "d2", "n_lines", at.alias("at"))).filter(F.size("at") > 0)
    found = drops.groupBy("d1", "d2").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))
    return found.select("d1", "d2", "n_lines", _bitmap("n_lines", "at").alias("x")).select("d1", "d2", "n_lines", "x.*")


@F.pandas_udf(T.StringType())
def _applied(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else "\n".join(kept_lines(t.split("\n"), k)) for t, k in zip(text, keep, strict=True)], dtype=object)


def applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the lines that the bitmaps keep (the whole text, empty for null, without one)."""
    d1, d2, dropped, bits = free_names(docs, "d1", "d2", "dropped", "bits")
    mine = _document(docs)
    kept = bitmaps.select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("n_dropped").alias(dropped), F.col("keep").alias(bits))
    both = docs.withColumns({d1: mine[0], d2: mine[1]}).join(kept, [d1, d2], "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    new = _applied(F.when(F.col(bits).isNotNull(), text), F.col(bits))
    return both.select(*docs.columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.col(dropped), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(new, text).alias("kept"))
