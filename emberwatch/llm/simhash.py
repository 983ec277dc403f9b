"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints that differ in few bits agree on some block of bits. Each distinct fingerprint is dealt
out once per block (key); only those that share a key are compared. Links are reduced to a forest
where they are found, so that a group of thousands doesn't yield all its pairs.

Defined cases: null text counts as empty; empty texts have fingerprint zero and link like any other;
texts of fewer words than a shingle have one shingle of all words; repeated rows are separate members
of the same group; a null doc_id takes part but is never the smallest; columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, free_names, sorted_in
from .components import Forest, connected_components

#: Fingerprints of a key that one task compares with each other or with as many others.
CELL = 512
#: Members of a larger key that all of its members are compared with first.
LEADERS = 32
#: How often those that no leader has linked choose new ones.
ROUNDS = 4
#: Slots in which shingles are counted to order them; their counts (8 MB) are broadcast.
SLOTS = 1 << 20
CHUNK = 65_536
#: Hashes that find similar sets, each of the least values of ROWS hash functions: sets of a similarity of 0.8 agree in none of them
#: with a probability of (1 - 0.8 ** ROWS) ** BANDS, 1 in 9000, however many sets there are.
BANDS, ROWS = 30, 6
TIMES, PLUS = np.random.default_rng(11).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32) | np.uint32(1)
MIXED = np.random.default_rng(12).integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def _digests(text: str | None, ngram: int, bits: int) -> Iterator[np.ndarray]:
    """Bytes of the shingles' hashes, a row per shingle, in chunks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh128_digest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - ngram + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(ngram, len(words)) - 1 :].tolist()
    for k in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK], strict=True)])
        yield np.frombuffer(raw, np.uint8).reshape(-1, bits // 8)


def _majority(digests: Iterable[np.ndarray], bits: int) -> bytes:
    n, ones = 0, np.zeros(bits, np.int64)
    for raw in digests:
        n += len(raw)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprint(text: str | None, ngram: int, bits: int) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    return _majority(_digests(text, ngram, bits), bits)


def signature(text: str | None, ngram: int, bits: int) -> tuple[bytes, np.ndarray]:
    """The fingerprint, and 64 bits of the hash of each distinct shingle, sorted."""
    digests = list(_digests(text, ngram, bits))
    own = [np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel() for raw in digests]
    return _majority(digests, bits), np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS hashes of a set of 64-bit hashes; two sets agree in each with a probability of their similarity ** ROWS."""
    if not len(own):
        return np.zeros(0, np.int64)
    short, least = (own.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(short), 512):
        values = TIMES * short[k : k + 512]
        values += PLUS
        np.minimum(least, values.min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * MIXED).sum(axis=1, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, ngram: int = 3, bits: int = 64) -> DataFrame:
    """doc_id, fp (binary) of every row, whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [fingerprint(t, ngram, bits) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp binary")


def pigeonhole_keys(bits: int, blocks: int, agree: int) -> list[list[int]]:
    """Bit positions of the keys: any `agree` of `blocks` blocks. Complete for distances up to blocks - agree."""
    parts = [p.tolist() for p in np.array_split(np.arange(bits), blocks)]
    return [sum(c, []) for c in combinations(parts, agree)]


def permuted_keys(bits: int, width: int, permutations: int, seed: int = 7) -> list[list[int]]:
    """Bit positions of the keys: disjoint blocks of several permutations of the bits.

    Each permutation alone is complete for distances below bits / width; more of them find pairs that
    are further apart with a probability that grows with their number.
    """
    rng, keys = np.random.default_rng(seed), []
    for k in range(permutations):
        order = rng.permutation(bits) if k else np.arange(bits)
        keys += [order[i : i + width].tolist() for i in range(0, bits - width + 1, width)]
    return keys


def _deal(keys: list[list[int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            raw = np.frombuffer(b"".join(map(bytes, pdf["fp"])), np.uint8).reshape(len(pdf), -1)
            on = np.unpackbits(raw, axis=1)
            for k, at in enumerate(keys):
                value = on[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))
                yield pd.DataFrame({"key": value * len(keys) + k, **{c: pdf[c] for c in pdf}})

    return run


def _near(fp: np.ndarray, n: np.ndarray | None, i: np.ndarray, j, most: int, alike: float) -> np.ndarray:
    near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= most
    if n is not None:  # sets of such sizes can't be similar
        near &= np.minimum(n[i], n[j]) >= alike * np.maximum(n[i], n[j]) - 1e-9
    return near


def _tree(count: int, side: np.ndarray | None, near) -> list[tuple[int, int]]:
    """Links of a spanning forest of one cell's members, by breadth-first search; near(left, x) says which of
    left are linked to x; side: only links across count."""
    left, out = np.arange(count), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            own = near(left, x)
            if side is not None:
                own &= side[left] != side[x]
            out += [(int(x), int(y)) for y in left[own]]
            queue += left[own].tolist()
            left = left[~own]
    return out


def _cell_starts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = pdf[["key", "x", "y"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
    return cells, starts, np.diff(np.r_[starts, len(pdf)])


def _by_cell(links):
    """links(rows of whole cells, forest) over batches that are sorted by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, rest = Forest(), None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[["key", "x", "y"]].to_numpy()
            at = int(np.flatnonzero((last != last[-1]).any(axis=1))[-1] + 1) if (last != last[-1]).any() else 0
            rest = pdf.iloc[at:].reset_index(drop=True)
            if at:
                yield pd.DataFrame(links(pdf.iloc[:at].reset_index(drop=True), forest), columns=["a", "b"], dtype="int64")
        if rest is not None and len(rest):
            yield pd.DataFrame(links(rest, forest), columns=["a", "b"], dtype="int64")

    return run


def _link(most: int, alike: float):
    def links(pdf: pd.DataFrame, forest: Forest) -> list[tuple[int, int]]:
        fp = np.frombuffer(b"".join(map(bytes, pdf["fp"])), ">u8").astype(np.uint64).reshape(len(pdf), -1)
        ids, n = pdf["nid"].to_numpy(), pdf["n"].to_numpy() if "n" in pdf else None
        cells, starts, sizes = _cell_starts(pdf)
        run, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
        small, found = np.flatnonzero((size > 1) & (size <= 24)), []
        for k in range(1, 24):
            i = small[small + k < len(pdf)]
            i = i[run[i] == run[i + k]]
            if not len(i):
                break
            i = i[_near(fp, n, i, i + k, most, alike)]
            found.append(np.stack([ids[i], ids[i + k]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0).tolist() if found else []
        out = forest.kept(pairs)
        for k in np.flatnonzero(sizes > 24):
            a, b = starts[k], starts[k] + sizes[k]
            side = pdf["part"].to_numpy()[a:b] if cells[a, 1] != cells[a, 2] else None
            own, sets = fp[a:b], None if n is None else n[a:b]
            tree = _tree(b - a, side, lambda left, x, own=own, sets=sets: _near(own, sets, left, x, most, alike))
            out += forest.kept([(int(ids[a + p]), int(ids[a + q])) for p, q in tree])
        return out

    return _by_cell(links)


def _alike(sets: list[np.ndarray], similarity: float):
    """near(left, x) for _tree: the exact Jaccard similarity of sets (sorted, distinct) is `similarity` or more."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    known, first = np.unique(values[order], return_index=True)
    rows, first = np.repeat(np.arange(len(sets)), sizes)[order], np.r_[first, len(values)]

    def near(left: np.ndarray, x) -> np.ndarray:
        at = np.searchsorted(known, sets[x])
        n = first[at + 1] - first[at]
        holders = rows[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(holders, minlength=len(sets))[left]
        return both / np.maximum(sizes[left] + sizes[x] - both, 1) >= similarity

    return near


def _verify(similarity: float):
    def links(pdf: pd.DataFrame, forest: Forest) -> list[tuple[int, int]]:
        sets = [np.frombuffer(s, np.int64) for s in pdf["own"]]
        ids, parts = pdf["nid"].to_numpy(), pdf["part"].to_numpy()
        cells, starts, sizes = _cell_starts(pdf)
        out = []
        for k in np.flatnonzero(sizes > 1):
            a, b = starts[k], starts[k] + sizes[k]
            side = parts[a:b] if cells[a, 1] != cells[a, 2] else None
            tree = _tree(b - a, side, _alike(sets[a:b], similarity))
            out += forest.kept([(int(ids[a + p]), int(ids[a + q])) for p, q in tree])
        return out

    return _by_cell(links)


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _whole(rows: DataFrame) -> DataFrame:
    return _sorted(rows.withColumns({"x": F.lit(0), "y": F.lit(0), "part": F.lit(0)}))


def _led(rows: DataFrame) -> DataFrame:
    """Cells of large keys (rows with `cells`) that hold a share of the key's members and its leaders each."""
    leaders = rows.groupBy("key", F.pmod(F.xxhash64("nid"), F.lit(LEADERS)).alias("slot")).agg(F.min("nid").alias("nid")).select("key", "nid")
    leaders = few(cut(leaders))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    lead = rows.join(leaders, ["key", "nid"]).withColumns({"x": every, "part": F.lit(1)})
    members = rows.withColumns({"x": F.pmod(F.xxhash64("nid"), F.col("cells")).cast("int"), "part": F.lit(0)})
    return _sorted(members.unionByName(lead).drop("cells").withColumn("y", F.lit(-1)))


def _across(rows: DataFrame) -> DataFrame:
    """Cells that hold each pair of a key's rows (key, nid, root, more) with different roots: all that aren't of the key's most
    frequent root meet all, CELL of each at once. Keys of one root have no cells."""
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    main = main.filter("n > most").select("key", "main", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), F.ceil((F.col("n") - F.col("most")) / CELL).cast("int").alias("rests"))
    own = rows.join(few(cut(main)), "key")

    def place(n: str):
        return F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rest = own.filter("root <> main").withColumns({"x": place("rests"), "y": every("cells"), "part": F.lit(0)})
    all_ = own.withColumns({"x": every("rests"), "y": place("cells"), "part": F.lit(1)})
    return _sorted(rest.unionByName(all_).withColumn("y", -1 - F.col("y")).drop("main", "cells", "rests", "root"))


def _forest(rows: DataFrame, counted: DataFrame, check, across=_across, dear: bool = False) -> DataFrame:
    """check's links (a, b) over the rows (key, nid, more) of each key, enough to join all that its links join.
    dear: the rows cost much to compute, and are kept if they are needed more than once.

    A key of at most CELL members (rows of counted) is one cell. Of a larger one, cells of members first meet LEADERS of them,
    in up to ROUNDS rounds, which makes one component of near copies in linear time; then only pairs of different components
    are compared, and those all.
    """
    large = counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    large = cut(large.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("cells")))
    if large.isEmpty():
        return check(_whole(rows))
    large, rows = few(large), cut(rows) if dear else rows
    own = rows.join(large, "key")
    own = own if dear else cut(own)
    left, first = own, None
    for _ in range(ROUNDS):  # those that no leader has linked choose leaders again; what is left over is compared below
        found = cut(check(_led(left)))
        if first is not None and found.isEmpty():  # more leaders would hardly find any
            break
        first = found if first is None else first.unionByName(found)
        linked = few(found.select(F.explode(F.array("a", "b")).alias("nid")))
        left = left.drop("cells").join(linked, "nid", "left_anti")
        still = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
        still = cut(still.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("cells")))
        if still.isEmpty():
            break
        left = left.join(few(still), "key").select(*own.columns)
    roots = connected_components(first)
    named = own.drop("cells").join(sorted_in(roots), F.col("nid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "nid")).drop("node")
    small = check(_whole(rows.join(large, "key", "left_anti")))
    return small.unionByName(first).unionByName(check(across(named)))


def _prefixes(similarity: float):
    """Postings of sets' prefixes, for _forest: key (of group and shingle), nid, root, own.

    Within a group, sets of that similarity share one of the shingles that are rarest in their common order, |set| -
    ceil(similarity * |set|) + 1 of each. The order goes by counts in SLOTS slots, over all sets of groups of several roots,
    then by the shingle. Only postings of several roots have their sets moved.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, np.int64)
        for pdf in batches:
            for s in pdf["own"]:
                np.add.at(n, np.frombuffer(s, np.int64) & (SLOTS - 1), 1)
        slots = np.flatnonzero(n)
        yield pd.DataFrame({"slot": slots, "n": n[slots]})

    def across(named: DataFrame) -> DataFrame:
        several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        rows = named.join(few(cut(several.select("key"))), "key")
        summed = rows.select("own").mapInPandas(counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 12 bytes a slot
        often = np.zeros(SLOTS, np.int64)
        often[summed["slot"].to_numpy()] = summed["n"].to_numpy()
        held = named.sparkSession.sparkContext.broadcast(often)

        def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                first = []
                for s in pdf["own"]:
                    s = np.frombuffer(s, np.int64)
                    order = np.lexsort((s, held.value[s & (SLOTS - 1)]))
                    first.append(s[order[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]])
                sizes = [len(f) for f in first]
                at = np.repeat(np.arange(len(pdf)), sizes)
                yield pd.DataFrame({**{c: pdf[c].to_numpy()[at] for c in ("key", "nid", "root")}, "shingle": np.concatenate([*first, np.zeros(0, np.int64)])})

        posts = rows.mapInPandas(post, "key long, nid long, root long, shingle long").select(F.xxhash64("key", "shingle").alias("key"), "nid", "root")
        mixed = posts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        return _across(posts.join(sorted_in(cut(mixed.select("key"))), "key").join(sorted_in(rows.select("nid", "own")), "nid"))

    return across


def links(distinct: DataFrame, keys: list[list[int]] | None, most: int, alike: float = 0.0) -> DataFrame:
    """Rows (a, b): enough links between rows (nid, fp) at most `most` bits apart that share a key, to
    join all that such links join. With a column n (sizes of sets), only sets that can have a Jaccard
    similarity of `alike` are linked. keys: positions of bits of fp; None: the hashes of a column `bands`.
    """
    more = [c for c in ("n",) if c in distinct.columns]
    if keys is None:
        dealt = distinct.select("nid", "fp", *more, F.posexplode("bands").alias("k", "hash")).select(F.xxhash64("k", "hash").alias("key"), "nid", "fp", *more)
    else:
        dealt = distinct.select("nid", "fp", *more).mapInPandas(_deal(keys), ", ".join(["key long, nid long, fp binary", *[f"{c} int" for c in more]]))
    return _forest(dealt, dealt, lambda cells: cells.mapInPandas(_link(most, alike), "a long, b long"))


def simhash_groups(docs: DataFrame, *, ngram: int = 3, bits: int = 64, most: int = 3, keys: list[list[int]] | None = None) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) for every row of docs.

    keys: bit positions per block; by default all choices of three of six blocks, complete for three bits.
    """
    keys = keys or pigeonhole_keys(bits, 6, 3)
    fps = cut(fingerprints(docs, ngram, bits))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("nid", F.monotonically_increasing_id()))
    comps = connected_components(links(distinct, keys, most))
    named = distinct.join(comps, distinct["nid"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "nid").alias("root"))
    named = cut(named)
    roots = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))  # so that the join of a large group can be split
    return fps.join(named.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


SIMILARITY = 0.8


def near_keys(n: int, *, bits: int = 128, similarity: float = SIMILARITY, miss: float = 1e-3, per_key: int = 8) -> list[list[int]]:
    """Keys for n fingerprints, so that a key's members don't grow with n and the share of pairs missed doesn't either.

    Two sets of that similarity (Jaccard) differ in a bit with probability angle / pi. A key of w bits has n / 2^w
    members by chance (w: about per_key of them), and holds a true pair with (1 - angle / pi)^w; so many keys are taken
    that all of them miss it with a probability of `miss`.
    """
    agree = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    width = int(min(max(np.ceil(np.log2(max(n, 1) / per_key)), 12), bits // 4))
    return permuted_keys(bits, width, int(np.ceil(np.log(miss) / np.log1p(-(agree**width)) / (bits // width))))


#: Five-word shingles, 128 bits; a similarity of 0.8 is an angle of 0.476, so 19.4 of 128 bits on average;
#: 32 is three standard deviations more. What is linked by chance is taken out when sets are compared.
NEAR = {"ngram": 5, "bits": 128, "most": 32}


def near_groups(docs: DataFrame, *, ngram: int = 5, bits: int = 128, most: int = 32, keys: list[list[int]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key (hash of the text), component_id, component_key for every row of docs: the last two name the row
    of the group with the smallest doc_id (null last), then text_key. Links are pairs whose sets of shingles have a
    Jaccard similarity of `similarity` or more; groups are what links reach.

    Hashes of least values (bands), or keys of fingerprint bits if they are given, and fingerprints only find the candidates:
    what their links join is a group, and in each group no pair of different components is left uncompared by its sets, so
    that neither a chance likeness joins nor a pair is lost to one. Only the members of such groups have their sets moved.
    Equal sets are one node.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [signature(t, ngram, bits) for t in pdf["text"]]
            same = [xxhash.xxh128_digest(s.tobytes()) for _, s in own]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "fp": [f for f, _ in own], "same": same, "n": [len(s) for _, s in own], "bands": [bands(s) for _, s in own]})

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "nid": pdf["nid"], "own": [signature(t, ngram, bits)[1].tobytes() for t in pdf["text"]]})

    signed = cut(rows.mapInPandas(sign, "doc_id long, text_key long, fp binary, same binary, n int, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key", "fp", "n", "bands")).alias("first")
    distinct = cut(signed.groupBy("same").agg(first).select("same", "first.*").withColumn("nid", F.monotonically_increasing_id()))
    likely = connected_components(links(distinct, keys, most, similarity))
    members = cut(distinct.join(sorted_in(likely), distinct["nid"] == likely["node"]).select(F.col("root").alias("key"), "nid", F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")))
    held = rows.join(sorted_in(members), rows["doc_id"].eqNullSafe(members["__d"]) & (rows["text_key"] == members["__t"]))
    held = held.select("key", "nid", "text").dropDuplicates(["nid"]).mapInPandas(sets, "key long, nid long, own binary")
    comps = connected_components(_forest(held, members, lambda cells: cells.mapInPandas(_verify(similarity), "a long, b long"), _prefixes(similarity), dear=True))
    named = cut(distinct.join(sorted_in(comps), distinct["nid"] == comps["node"], "left").select("same", "no", "doc_id", "text_key", F.coalesce("root", "nid").alias("root")))
    roots = named.groupBy("root").agg(F.min(F.struct("no", "doc_id", "text_key")).alias("least"))
    roots = cut(roots.select("root", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("component_key")))
    return signed.join(sorted_in(named.join(sorted_in(roots), "root").select("same", "component_id", "component_key")), "same").select("doc_id", "text_key", "component_id", "component_key")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs but those whose group (near_groups) has a row before them; columns as they are.

    Rows are told apart by doc_id and text, so a row that shares only its doc_id with a copy stays. Of rows with
    equal doc_id and text one stays, the one whose other columns hash least. A null doc_id comes after all
    others; a null text counts as empty, and all texts without words are copies of each other; very long
    texts are read whole; an empty table gives no rows; columns of any other names are kept.
    """
    d, t, n = free_names(docs, "d", "t", "n")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    groups = cut(near_groups(docs, **(NEAR | how)))
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    gone = groups.filter(~is_first).select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    kept = docs.join(sorted_in(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left_anti")
    again = cut(groups.filter(is_first).groupBy(F.col("doc_id").alias(d), F.col("text_key").alias(t)).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1))
    if again.isEmpty():
        return kept
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same).groupBy(d, t).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(n)).select(f"{n}.*")
    return kept.join(again, same, "left_anti").unionByName(one)
