"""Spelling variants: words at distance one, by a self-join of the vocabulary's trie.

Words at distance one share their first or their last half. So the trie is partitioned by prefixes of half a word, forwards and
backwards; a word is in both, once with those of its length and once with those one shorter. In each partition the active nodes of
a node (those at distance one) are propagated to its children: the parent, the siblings, the children, and of the parent's active nodes
the children by the same letter. Words at active nodes are pairs. A partition of too many words is split by half of what is left of
its words, forwards and backwards again, until one letter is left; so none is beyond what a task holds, and no pair is lost.

Defined cases: null and empty texts have no words; a null doc_id counts as empty text; repeated rows count each; words of any
length are taken whole; ties of frequency go to the word that is first in code-point order; an empty table gives no rows; columns
other than doc_id and text aren't looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of which one task builds a trie.
GROUP = 20_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
LETTERS = "a-zÀ-ÿ"


def counted(batches: Iterator[pa.RecordBatch], least_chars: int, slip: int | None) -> Iterator[pa.RecordBatch]:
    """(word, n) of batches of (doc_id as text, text as bytes); a word may come more than once."""
    runs, words = re.compile(f"[{LETTERS}]{{{least_chars},}}"), Counter()

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
        words.clear()
        return out

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = Counter(runs.findall((raw.as_py() or b"").lower().decode("utf-8", "replace")))
            if slip is None:
                words.update(own)
                continue
            start = zlib.crc32(f"{doc_id or ''}:".encode())
            for word, n in own.items():
                h = zlib.crc32(word.encode(), start)
                if h % slip == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least_chars:
                        continue
                words[word] += n
            if len(words) > COUNTED:
                yield taken()
    yield taken()


def word_counts(docs: DataFrame, *, least_chars: int = 6, often: int = 5, slip: int | None = None) -> DataFrame:
    """(word, n): runs of letters of Latin-1, A-Z lower-cased, of least_chars code points that occur at least `often` times.

    slip: a run whose crc32 together with its document's id is divisible by it loses a letter, as by a slip of the pen.
    """
    sent = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary"))
    parts = sent.mapInArrow(lambda batches: counted(batches, least_chars, slip), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j) of all words at distance one, both ways round."""
    children, ends = [{}], [None]
    for i, word in enumerate(words):
        node = 0
        for letter in word:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                ends.append(None)
            node = children[node][letter]
        ends[node] = i
    stack = [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if ends[node] is not None:
            yield from ((ends[node], ends[v]) for v in active if ends[v] is not None)
        own = set(children[node].values())
        for letter, child in children[node].items():
            near = {children[v][letter] for v in active if letter in children[v]}
            near.update(own, children[child].values())
            near.add(node)
            near.discard(child)
            stack.append((child, near))


KEY = ["size", "head", "tail", "k1", "k2"]


def _parts(words: DataFrame, size: Column, head: Column, tail: Column) -> DataFrame:
    """words, each in the two partitions of its `size` that share one letter more or half of what is left between `head`
    letters at the beginning and `tail` at the end."""
    left = size - head - tail
    half = F.floor(left / 2)
    forward = F.struct(size.alias("size"), (head + half).alias("head"), tail.alias("tail"))
    backward = F.struct(size.alias("size"), head.alias("head"), (tail + left - half).alias("tail"))
    split = words.select("word", "n", F.explode(F.array(forward, backward)).alias("x")).select("word", "n", *[F.col(f"x.{k}").cast("int").alias(k) for k in KEY[:3]])
    return split.withColumns({"k1": F.xxhash64(F.substring("word", F.lit(1), F.col("head"))), "k2": F.xxhash64(F.when(F.col("tail") > 0, F.expr("right(word, tail)")))})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each partition; batches are sorted by KEY."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True)

    out = []
    for key, group in groupby(rows(), key=lambda r: r[:5]):
        size, head, tail = key[:3]
        parts = defaultdict(list)
        for *_, word, n in group:  # the keys are hashes
            parts[word[:head], word[len(word) - tail :]].append((word, n))
        for part in parts.values():
            if len(part) == 1:
                continue
            for i, j in trie_pairs([w[head : len(w) - tail] for w, _ in part]):
                a, b = part[i][0], part[j][0]
                if min(len(a), len(b)) == size:
                    out.append((a, *part[j]))
            if len(out) > 50_000:
                yield _batch(out)
                out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def near_pairs(words: DataFrame, *, group: int = GROUP) -> DataFrame:
    """(word, near, near_n) for words (word, n) at distance one, both ways round; a pair that differs by a letter of a run of equal
    ones may come twice."""
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
    parts, found = _parts(sized, F.col("size"), F.lit(0), F.lit(0)), None
    while True:
        # never more keys than words / group; of one letter no partition can be large
        large = parts.filter(F.col("size") - F.col("head") - F.col("tail") > 1).groupBy(*KEY).count().filter(F.col("count") > group).select(*KEY)
        large = cut(large)
        more = large.count()
        done = parts.join(large, KEY, "left_anti") if more else parts
        pairs = done.select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_joined, "word string, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found
        parts = _parts(cut(parts.join(large, KEY, "left_semi")), F.col("size"), F.col("head"), F.col("tail"))


def variants(words: DataFrame, *, ratio: int = 5, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), one row each.

    form is the most frequent word at distance one, if it is at least `ratio` (above 1) times as frequent; root is where forms lead.
    Every step multiplies the frequency by ratio, so that the steps are few and are doubled in fewer rounds still.
    """
    if ratio <= 1:
        raise ValueError("ratio has to be above 1")
    words = cut(words.select("word", F.col("n").cast("long")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words, group=group).groupBy("word").agg(F.count_distinct("near").alias("n_near"), best)
    found = words.join(near, "word", "left")
    formed = -F.col("best.n") >= ratio * F.col("n")
    out = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")))
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log(most, ratio)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("on"))
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
