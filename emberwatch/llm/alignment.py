"""Alignment of two tokenizers' tokens over the same bytes, and how often pairs of their ids are linked in the corpus.

A text is cut where a space follows something that isn't white space. Neither tokenizer has a token across such a place,
so each distinct stretch of a block of documents is encoded and aligned once, and a document's alignment is that of its
stretches in a row. Within a block, the ends of all stretches' tokens on both sides give elementary intervals (union1d); the token
that owns an interval on either side is found by binary search (searchsorted), and each interval is one overlap of two
tokens. An end on both sides closes a group.

Links are, by choice, pairs of tokens that overlap ("overlap"), that are in the same group ("group": the product
of its sides), or that end together ("end").

Counts of id pairs are summed per block of documents (a few MB of text), then over all blocks; the sums go back to the blocks that
asked, so what moves is as much as blocks have distinct pairs, not tokens.

Defined cases: null and empty texts, and texts whose tokens' bytes aren't the text's with a space before it, have no tokens:
zeros and an empty digest. Repeated rows are documents of their own and count each. A null doc_id is kept. Columns other than
doc_id and text aren't looked at. A text longer than a block is a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_worker

#: Bytes of text of which one block is made, if no single text has more.
BLOCK = 8 << 20
#: Ids are below this on either side.
IDS = 1 << 20
#: Places that no token of either side crosses.
CUTS = re.compile(r"(?<=\S)(?= )")
KINDS = ("end", "overlap", "group")


@dataclass
class Aligned:
    """Alignment of some stretches: per stretch whether its bytes agree, its numbers of tokens and groups, its groups as text, and its
    links, as places `link_at[i]:link_at[i + 1]` of `a` and `b`."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    link_at: np.ndarray
    a: np.ndarray
    b: np.ndarray


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of side A, owner of side B, whether both end with it) of each elementary interval between two rows of token ends
    over the same bytes."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def group_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within the same group, given each token's group (both ascending from 0 without gaps)."""
    n_a, n_b = np.bincount(a), np.bincount(b)
    first_b = np.cumsum(n_b) - n_b
    each = n_b[a]  # of every token of A, as many pairs as its group has tokens of B
    left = np.repeat(np.arange(len(a)), each)
    within = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    return left, first_b[a[left]] + within


class Pair:
    """Both tokenizers, and each token's bytes."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_bpe, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)  # so that no piece crosses CUTS
        self.space = self.b.piece_to_id("▁")
        by_id = {i: t for t, i in ranks.items()}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))

    def stretches(self, text: str) -> list[str]:
        return CUTS.split(f" {text}") if self.cuts else [f" {text}"]

    def align(self, stretches: list[str], kind: str) -> Aligned:
        ids_a = [self.a.encode_ordinary(s) for s in stretches]
        ids_b = self.b.encode([s[1:] for s in stretches], num_threads=1) if stretches else []
        ids_b = [x if s != " " else [self.space] for s, x in zip(stretches, ids_b, strict=True)]
        good = np.zeros(len(stretches), bool)
        for i, (s, x, y) in enumerate(zip(stretches, ids_a, ids_b, strict=True)):
            raw = s.encode("utf-8", "surrogatepass")
            good[i] = b"".join(map(self.bytes_a.__getitem__, x)) == raw == b"".join(map(self.bytes_b.__getitem__, y))
        n_a, n_b = (np.array([len(x) for x in own], np.int64) * good for own in (ids_a, ids_b))
        a, b = (np.array([i for x, ok in zip(own, good, strict=True) if ok for i in x], np.int64) for own in (ids_a, ids_b))
        own_a, own_b, shared = elementary(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        # the group of each token; ends of stretches are shared, so no group crosses one
        group = np.cumsum(shared) - shared
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[own_a], group_b[own_b] = group, group
        of = np.repeat(np.arange(len(stretches)), n_a)  # the stretch of each token of A
        first = np.r_[True, group_a[1:] != group_a[:-1]] if len(a) else np.zeros(0, bool)
        n_groups = np.bincount(of[first], minlength=len(stretches))
        if kind == "end":
            left, right = own_a[shared], own_b[shared]
        elif kind == "overlap":
            left, right = own_a, own_b
        else:
            left, right = group_products(group_a, group_b)
        links = np.bincount(of[left], minlength=len(stretches)) if len(left) else np.zeros(len(stretches), np.int64)
        return Aligned(good, n_a, n_b, n_groups, _written(a, b, group_a, group_b, n_a + n_b), np.r_[0, np.cumsum(links)], a[left], b[right])


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Each stretch's groups, as a1,a2|b1;a3|b2,b3."""
    tokens = np.empty(len(a) + len(b), object)
    for own, other, ids, group, last in ((0, 1, a, group_a, "|"), (1, 0, b, group_b, ";")):
        at = np.arange(len(ids)) + np.searchsorted((group_a, group_b)[other], group, side="right" if own else "left")
        ends = np.r_[group[1:] != group[:-1], True] if len(ids) else np.zeros(0, bool)
        tokens[at] = [f"{i}{last if end else ','}" for i, end in zip(ids.tolist(), ends.tolist(), strict=True)]
    stops = np.cumsum(sizes)
    return ["".join(tokens[stop - n : stop])[:-1] for n, stop in zip(sizes.tolist(), stops.tolist(), strict=True)]


def _decoded(raw: bytes) -> str:
    """Text of bytes; none, if they aren't UTF-8."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


HEAD = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, pairs array<long>, counts array<long>, places binary"
TYPES = [pa.int64(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<i4").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4")


def _block(number: int, docs: list[tuple], pair: Pair, kind: str) -> pa.RecordBatch:
    """A row per document, with its stretches by number, and one row for the block: its distinct pairs, how often it links each, and
    the links of each stretch as places among the pairs."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    own = [np.array([known[s] for s in pair.stretches(text)] if text else [], np.int64) for _, text in docs]
    al = pair.align(list(known), kind)
    pairs, places = np.unique(al.a * IDS + al.b, return_inverse=True)
    links = np.diff(al.link_at)
    uses, rows = np.zeros(len(known), np.int64), []
    for (doc_id, _), x in zip(docs, own, strict=True):
        if not len(x) or not al.good[x].all():
            rows.append((number, doc_id, 0, 0, 0, 0, "", None, None, None, None))
            continue
        uses += np.bincount(x, minlength=len(known))
        digest = hashlib.sha256(";".join(map(al.groups.__getitem__, x.tolist())).encode()).hexdigest()
        rows.append((number, doc_id, *(int(n[x].sum()) for n in (al.n_a, al.n_b, al.n_groups, links)), digest, _packed(x), None, None, None))
    counts = np.bincount(places, weights=np.repeat(uses, links), minlength=len(pairs)).astype(np.int64)
    seen = np.r_[[len(known)], links, places]
    rows.append((number, None, None, None, None, None, None, None, pairs, counts, _packed(seen)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], [x.split()[0] for x in HEAD.split(", ")])


def blocks(docs: DataFrame, *, byte_bpe: str | None = None, piece_bpe: str | None = None, links: str = "end") -> DataFrame:
    """Documents aligned in blocks; see _block. byte_bpe is a file of ranks, piece_bpe a sentencepiece model."""
    import public_tokenizers

    if links not in KINDS:
        raise ValueError(f"links: one of {KINDS}")
    byte_bpe = byte_bpe or public_tokenizers.path("byte_bpe_50k.tiktoken")
    piece_bpe = piece_bpe or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = per_worker(f"alignment {byte_bpe} {piece_bpe}", lambda: Pair(byte_bpe, piece_bpe))
        number, some, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                if some and size + len(raw) > BLOCK:
                    yield _block(number, some, pair, links)
                    number, some, size = number + 1, [], 0
                some.append((doc_id.as_py(), _decoded(raw)))
                size += len(raw)
        if some:
            yield _block(number, some, pair, links)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, HEAD)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of one block with the corpus-wide counts of their links."""
    rows = docs.to_pydict()
    head = next(i for i, p in enumerate(rows["places"]) if p is not None)
    seen = _unpacked(rows["places"][head])
    links, places = seen[1 : seen[0] + 1], seen[seen[0] + 1 :]
    n, best = np.zeros(len(rows["pairs"][head]), np.int64), np.zeros(len(rows["pairs"][head]), np.int64)
    at = totals.column("at").to_numpy()
    n[at], best[at] = totals.column("n").to_numpy(), totals.column("best").to_numpy()
    stops = np.cumsum(links)
    # sums of each stretch's links, from running sums
    sums = [np.r_[0, np.cumsum(x[places])][np.c_[stops - links, stops]] @ [-1, 1] for x in (best, n)]
    kept = [i for i in range(len(rows["doc_id"])) if i != head]
    own = [_unpacked(rows["own"][i]) if rows["own"][i] else [] for i in kept]
    out = {k: [rows[k][i] for i in kept] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    out |= {k: [int(s[x].sum()) if len(x) else 0 for x in own] for k, s in zip(("n_best", "count_sum"), sums, strict=True)}
    out["groups_sha256"] = [rows["groups_sha256"][i] for i in kept]
    return pa.table([pa.array(c, t) for c, t in zip(out.values(), [*[pa.int64()] * 7, pa.string()], strict=True)], list(out))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of all blocks: how often an id pair is linked, and whether no other id of A is linked more often
    with its id of B. pair is A's id times IDS, plus B's.

    A block has a pair once, so no pair is frequent here. There is one maximum per id of B, at most as many as B's vocabulary has.
    """
    found = aligned.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.*")
    totals = found.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")).filter("n > 0")
    most = totals.groupBy((F.col("pair") % IDS).alias("b")).agg(F.max("n").alias("most"))
    return totals.withColumn("b", F.col("pair") % IDS).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align_tokens(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, numbers of tokens, groups and links, and, over its links, how many have the
    highest count that their id of B has in the corpus, and the sum of the counts; groups_sha256 is the digest of its groups.

    how: see blocks().
    """
    aligned = cut(blocks(docs, **how))
    totals = cut(pair_counts(aligned))
    asked = aligned.filter("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(totals, "pair").select("of", F.col("at").cast("long"), "n", "best")
    return aligned.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_answered, OUT)
