"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are scaled to length one, rotated at random and dealt to lists by their nearest centroid. A
query scans the lists nearest to it. Within a list the rotated components are held in column blocks;
after each block a hypothesis test on the partial distance (a partial distance over d of D dimensions of
a rotated vector estimates the whole one within a factor of 1 + EPSILON / sqrt(d)) abandons
candidates that are too far to be among the k nearest. Cosines of what is found are computed from
the original vectors in double precision.

The centroids and the number of lists to probe are fitted on a bounded sample; all vectors are indexed.
Lists are cut into cells of bounded size, candidates and queries alike, so a list with a third of all
vectors is scanned in many places.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
null ids; vectors of another length than the query's have no cosine with it, so each length is searched
for itself, from the commonest on, and a query's candidates are those of its own length; ties go to the smaller id; repeated rows are
candidates each, and of repeated query ids the smallest vector asks; rows with the query's id are
not its candidates; an empty table gives no rows; columns other than id and vector are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

EPSILON = 2.1
BLOCKS = (8, 16, 32, 64, 128, 256, 512)  # dimensions after which the test is made
SAMPLE_VALUES, CELL, QUERIES_PER_CELL = 2_000_000, 4096, 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col("v")
    df = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0.0))


def _scaled(v: np.ndarray) -> np.ndarray:
    """v by a power of two that brings the largest component close to one: exact, and no product overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def fit(sample: np.ndarray, lists: int, k: int, target: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotation, centroids, and how many lists to probe for a recall of `target` within the sample."""
    dims = sample.shape[1]
    q, r = np.linalg.qr(rng.normal(size=(dims, dims)))
    rotation = q * np.sign(np.diag(r))
    x = _unit(sample) @ rotation
    lists = max(1, min(lists, len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8 if lists > 1 else 0):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=lists)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), lists)])
    own = _nearest(x, centres)
    asked = rng.choice(len(x), min(len(x), 256), replace=False)
    order = np.argsort(-(x[asked] @ centres.T - 0.5 * (centres * centres).sum(axis=1)), axis=1)
    place = np.argsort(order, axis=1)  # place of each list for each query
    found = []
    for i, a in enumerate(asked):
        near = x @ x[a]
        near[a] = -9
        top = np.argpartition(-near, min(k, len(x) - 1))[:k]
        found.append(place[i, own[top]])
    need = np.sort(np.concatenate(found)) if found else np.zeros(1, int)
    return rotation, centres, int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1


def scan(query: np.ndarray, columns: list[np.ndarray], ends: list[int], k: int) -> np.ndarray:
    """Candidates (places) that may be among the k nearest; columns: blocks of rotated components, dims x candidates."""
    n, dims = columns[0].shape[1], ends[-1]
    if n <= 4 * k:
        return np.arange(n)
    first = np.arange(min(n, 4 * k))
    bound = np.sort(sum(((c[:, first] - query[e - len(c) : e, None]) ** 2).sum(axis=0) for c, e in zip(columns, ends, strict=True)))[k - 1]
    alive, part = np.arange(n), np.zeros(n)
    for c, e in zip(columns, ends, strict=True):
        part = part + ((c[:, alive] - query[e - len(c) : e, None]) ** 2).sum(axis=0)
        keep = part <= bound + 1e-9 if e == dims else part * dims / e <= bound * (1 + EPSILON / np.sqrt(e)) ** 2 + 1e-9
        alive, part = alive[keep], part[keep]
    if len(alive) > k:
        alive = alive[part <= np.partition(part, k - 1)[k - 1] + 1e-9]
    return alive


def _cell(dims: int, k: int):
    ends = [e for e in BLOCKS if e < dims] + [dims]
    starts = [0, *ends[:-1]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["query"].to_numpy(bool)
        rows = np.stack(pdf["v"].to_numpy()).astype(float)
        turned = np.stack(pdf["r"].to_numpy()).astype(float)
        ids = pdf["vec_id"].to_numpy()
        mine, cand = ids[asks], ids[~asks]
        out = []
        if len(cand):
            raw, wide = _scaled(rows[~asks]), turned[~asks].T
            columns = [np.ascontiguousarray(wide[a:b]) for a, b in zip(starts, ends, strict=True)]
            norms = np.sqrt((raw * raw).sum(axis=1))
            for q, v, r in zip(mine, _scaled(rows[asks]), turned[asks], strict=True):
                at = scan(r, columns, ends, k + int((cand == q).sum()))
                at = at[cand[at] != q]
                score = (raw[at] * v).sum(axis=1) / (norms[at] * np.sqrt((v * v).sum()))
                best = np.lexsort((cand[at], -score))[:k]
                out += [(int(q), int(cand[at[j]]), float(score[j])) for j in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, lists: int | None = None, target: float = 0.95, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row where `queries` (over vec_id) holds.

    lists: how many there are, by default the square root of the number of vectors, as far as the sample has eight
    vectors for each; target: the recall within the sample that the number of probes is fitted for; SAMPLE_VALUES
    bounds the components of the sample that centroids and probes are fitted on, chosen by a hash of the id.
    """
    own = usable(vectors, key, vector)
    out = None
    for row in own.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").collect():  # as a rule there is one
        one = _search(own.filter(F.size("v") == row["dims"]), queries, row["dims"], row["count"], k, lists, target, seed)
        out = one if out is None else out.unionByName(one)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(own: DataFrame, queries: Column, dims: int, n: int, k: int, lists: int | None, target: float, seed: int) -> DataFrame:
    spark = own.sparkSession
    share = min(1.0, SAMPLE_VALUES / dims / n)
    sample = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(1_000_003 * share) + 1).select("vec_id", "v").toPandas().sort_values("vec_id")
    if not len(sample):
        sample = own.orderBy("vec_id").limit(1000).select("vec_id", "v").toPandas()
    rotation, centres, probes = fit(np.stack(sample["v"].to_numpy()).astype(float), lists or min(max(1, len(sample) // 8), math.isqrt(n)), k, target, np.random.default_rng(seed))
    sent = spark.sparkContext.broadcast((rotation, centres))

    def assign(batches):
        turn, mid = sent.value
        for pdf in batches:
            if len(pdf):
                x = _unit(np.stack(pdf["v"].to_numpy()).astype(float)) @ turn
                yield pdf.assign(r=list(x), list=_nearest(x, mid))

    dealt = cut(own.mapInPandas(assign, "vec_id long, v array<double>, r array<double>, list int"))
    counts = np.zeros(len(centres), np.int64)
    for row in dealt.groupBy("list").count().collect():
        counts[row["list"]] = row["count"]

    def probe(batches):
        _, mid = sent.value
        bias = 0.5 * (mid * mid).sum(axis=1)
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(-(np.stack(pdf["r"].to_numpy()) @ mid.T - bias), axis=1, kind="stable")
            enough = np.maximum(probes, 1 + np.argmax(np.cumsum(counts[order], axis=1) >= min(n, 4 * k + 1), axis=1))
            yield pdf.assign(list=[o[:e].tolist() for o, e in zip(order, enough, strict=True)])

    asking = dealt.filter(queries).groupBy("vec_id").agg(F.min(F.struct("v", "r")).alias("s")).select("vec_id", "s.v", "s.r")
    asked = cut(asking.mapInPandas(probe, "vec_id long, v array<double>, r array<double>, list array<int>").withColumn("list", F.explode("list")))
    wanted = np.zeros(len(centres), np.int64)
    for row in asked.groupBy("list").count().collect():
        wanted[row["list"]] = row["count"]
    plan = spark.createDataFrame([(i, int(-(-counts[i] // CELL)) or 1, int(-(-wanted[i] // QUERIES_PER_CELL))) for i in range(len(centres))], "list int, c int, q int")
    plan = F.broadcast(plan)  # a row per list, of which the sample bounds the number
    c, q = F.col("c"), F.col("q")
    sides = []
    for rows, is_query in ((dealt, False), (asked, True)):
        rows = rows.join(plan, "list").filter("q > 0")
        place = F.pmod(F.xxhash64("vec_id"), q if is_query else c).cast("int")
        others = F.explode(F.sequence(F.lit(0), (c if is_query else q) - 1))
        rows = rows.withColumn("place", place).withColumn("other", others)
        cells = ("other", "place") if is_query else ("place", "other")
        sides.append(rows.select("list", *[F.col(x).alias(y) for x, y in zip(cells, ("x", "y"), strict=True)], F.lit(is_query).alias("query"), "vec_id", "v", "r"))
    near = sides[0].unionByName(sides[1]).groupBy("list", "x", "y").applyInPandas(_cell(dims, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
