"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed longest first into the open sequence that fits best under every one of
them: by the smallest weighted norm of what is left, or by the largest weighted dot product of demand
and residual, over all open sequences. A piece that alone costs more attention than the capacity has a sequence
of its own.

Defined cases: null text counts as empty and still yields its end token; documents longer than a
sequence are cut into full pieces and a rest, others are never cut; repeated rows are packed each;
an empty table gives no rows; columns of documents other than doc_id and text are not looked at, those of pieces
are kept, whatever they are called.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, per_worker

#: Distinct pieces whose ids one worker remembers.
REMEMBERED = 250_000
#: Texts that are looked up together.
AT_ONCE = 256


#: The pieces that byte-pair merges never reach across, of lower-case text: letters, a contraction's end, one digit, marks.
PIECES = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
ASCII_PIECES = r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)} | {10: "\n"}


#: Code points below this are tried one by one when a worker starts; texts with any other go through the whole tokenizer.
TRIED = 0x3000
#: Where each is tried: by itself, between letters, digits and marks, and after what begins a contraction.
PLACES = ("{}", "x{}y", "X{}{}Y", "1{}1", ".{}.", " {} ", "a'{}", "a'l{}", "a'{}l", "a'r{}", "a'v{}")


class _Ids(dict):
    """Ids (packed, little-endian) of pieces, and of texts by their pieces.

    Pieces are merged once and then remembered. Whatever the pieces may be cut otherwise than by the tokenizer goes
    through the whole tokenizer: texts that hold a special token's mark, a sigma, whose lower case would
    depend on its place, or a code point that isn't trusted. Trusted are those that got the
    tokenizer's ids in every one of PLACES and were assigned in Unicode 3.2 already, whose normal forms are fixed.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), byte_letters()
        self.merges = Tokenizer(self.whole.model)
        self.last = np.zeros(self.whole.get_vocab_size(), bool)  # tokens that end a piece
        self.last[[k for w, k in self.whole.get_vocab().items() if w.endswith("</w>")]] = True
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces, self.ascii_pieces = regex.compile(PIECES), re.compile(ASCII_PIECES)
        self.odd = self._untrusted()

    def _untrusted(self) -> re.Pattern:
        """Of any code point that isn't trusted."""
        known = [k for k in range(128, TRIED) if unicodedata.ucd_3_2_0.category(chr(k)) not in ("Cn", "Cs", "Co")]
        tried = [p.format(*[chr(k)] * 2) for k in known for p in PLACES]
        want = [array("I", x.ids).tobytes() for x in self.whole.encode_batch(tried, add_special_tokens=False)]
        split = [self.pieces.findall(unicodedata.normalize("NFC", t).lower()) for t in tried]
        self.learn(sorted(set().union(*split)))
        same = [w == b"".join(map(self.__getitem__, own)) for w, own in zip(want, split, strict=True)]
        n = len(PLACES)
        good = {k for j, k in enumerate(known) if all(same[j * n : (j + 1) * n]) and k != 0x3A3}
        self.clear()
        spans, start = [], None
        for k in range(128, TRIED + 1):
            if k < TRIED and k not in good:
                start = k if start is None else start
            elif start is not None:
                spans.append((start, k - 1))
                start = None
        spans.append((TRIED, 0x10FFFF))
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")

    def learn(self, new: list[str]) -> None:
        joined = "\n".join(new).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        got = self.merges.encode_batch_fast([joined], add_special_tokens=False)[0]
        raw = array("I", got.ids).tobytes()
        ends = (4 * (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1)).tolist()
        self.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def split(self, text: str) -> list[str] | None:
        if "<|" in text:
            return None
        if text.isascii():
            return self.ascii_pieces.findall(text.lower())
        if self.odd.search(text):
            return None
        return self.pieces.findall(unicodedata.normalize("NFC", text).lower())

    def texts(self, texts: list[str | None], end: bytes) -> Iterator[bytes]:
        """Packed ids of each text and then end."""
        for k in range(0, len(texts), AT_ONCE):
            some = [t or "" for t in texts[k : k + AT_ONCE]]
            split = list(map(self.split, some))
            pieces = set().union(*filter(None, split))
            if len(self) > REMEMBERED:
                self.clear()
            if new := [p for p in pieces if p not in self]:
                self.learn(new)
            for text, own in zip(some, split, strict=True):
                if own is None:
                    yield array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes() + end
                else:
                    yield b"".join([*map(self.__getitem__, own), end])


def tokenised(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, most_tokens: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    tokenizer: path of a tokenizers JSON file; it has to lower-case, split as PIECES does, work on bytes
    and mark the ends of pieces, as the one by default does.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = per_worker(f"ids {tokenizer}", lambda: _Ids(tokenizer))
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(k, AT_ONCE)
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), known.texts(some.column(1).to_pylist(), end), strict=True):
                    for j, a in enumerate(range(0, len(ids) // 4, most_tokens)):
                        own = ids[4 * a : 4 * (a + most_tokens)]
                        rows.append((doc_id, j, a, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4")] if with_ids else [])))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. The attention of 2048 tokens is never above 2048 * 2048 and their documents never above
    2048, so by default only tokens bind and no sequence more than needed is begun; smaller ones bind."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    by: str = "norm"  # or "dot"


#: For sequences that cost a training step about as much as each other: at most 16 documents, and nine tenths of the
#: attention of one document of 2048 tokens, but for pieces that cost more by themselves.
BALANCED = Limits(documents=16, attention=9 * 2048 * 2048 // 10)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length; lengths are taken in the order given (longest first packs best).

    Every open bin under all three capacities is weighed; ties go to the bin opened first. Bins that no later piece
    fits are closed.
    """
    w = np.array(limits.weights) / np.array([limits.tokens, limits.documents, limits.attention], float)
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > limits.tokens or int(lengths.max()) ** 2 > limits.attention or limits.documents < 1):
        raise ValueError(f"a piece of {lengths.max()} tokens fits no sequence")
    rest = np.minimum.accumulate(lengths[::-1])[::-1]  # the shortest piece from here on
    tokens, docs, att, number = (np.zeros(1024, np.int64) for _ in range(4))
    bins, offsets, opened, m = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i % 256 == 0:
            keep = np.flatnonzero((tokens[:m] >= rest[i]) & (docs[:m] > 0) & (att[:m] >= rest[i] ** 2))
            for x in (tokens, docs, att, number):
                x[: len(keep)] = x[keep]
            m = len(keep)
        cost = n * n
        fits = np.flatnonzero((tokens[:m] >= n) & (docs[:m] > 0) & (att[:m] >= cost))
        if len(fits):
            t, d, a = tokens[fits], docs[fits], att[fits]
            if limits.by == "dot":
                score = -(w[0] ** 2 * n * t + w[1] ** 2 * d + w[2] ** 2 * cost * a)
            else:
                score = (w[0] * (t - n)) ** 2 + (w[1] * (d - 1)) ** 2 + (w[2] * (a - cost)) ** 2
            at = int(fits[np.argmin(score)])
        else:
            if m == len(tokens):
                tokens, docs, att, number = (np.r_[x, np.zeros(m, np.int64)] for x in (tokens, docs, att, number))
            at, m = m, m + 1
            tokens[at], docs[at], att[at], number[at] = limits.tokens, limits.documents, limits.attention, opened
            opened += 1
        bins[i], offsets[i] = number[at], limits.tokens - tokens[at]
        tokens[at], docs[at], att[at] = tokens[at] - n, docs[at] - 1, att[at] - cost
    return bins, offsets


def pack(pieces: DataFrame, limits: Limits = Limits(), *, pieces_per_task: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset.

    Pieces are dealt by a hash of their identity to tasks of about pieces_per_task, each packing its own
    share; a share leaves at most a few sequences part-empty, so the loss doesn't grow with the input.
    Full pieces, and those above the attention of a sequence, get a sequence each without being dealt out.
    """
    order = ["length", "doc_id", "piece", "ids_crc32"]
    most = min(limits.tokens - 1, math.isqrt(limits.attention))
    full = pieces.filter(F.col("length") > most)
    rest = pieces.filter(F.col("length") <= most)
    shards = max(1, -(-rest.count() // pieces_per_task))
    (shard,) = free_names(pieces, "shard")
    rest = rest.withColumn(shard, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[False, True, True, True], kind="stable", na_position="first")
        bins, offsets = best_fit(pdf["length"].to_numpy(), limits)
        out = pdf.drop(columns=shard).assign(sequence_id=bins * 2 * shards + 2 * pdf[shard].to_numpy(), offset=offsets)
        return out.astype({"doc_id": "Int64"})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = rest.groupBy(shard).applyInPandas(run, schema)
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)
