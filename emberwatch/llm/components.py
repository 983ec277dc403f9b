"""Connected components by alternating star contraction, all of it distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sorted_in

#: Links of which one task makes stars.
AT_ONCE = 250_000


class Forest:
    """Keeps the links that join two groups, of those that one task sees; the root of a group is its least node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def kept(self, pairs) -> list[tuple[int, int]]:
        out = []
        for a, b in pairs:
            x, y = self.find(a), self.find(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from the root of each group, of the links of one task, to its other nodes."""
    forest = Forest()
    for pdf in batches:
        forest.kept(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True))
    nodes = list(forest.up)
    yield pd.DataFrame({"u": nodes, "v": [forest.find(x) for x in nodes]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(sorted_in(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(sorted_in(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge, root being the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. First, shares of
    AT_ONCE links are cut to stars, each share in a task of its own, so that a group whose links were found in
    many places has few left; one share is all there is to do. Every round then is two hash aggregations and joins
    over the links, which are cut to one star per group as it goes; the minima are cut before they are joined, so that adaptive execution can
    split the joins' hubs.
    """
    now = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v"))
    shares = max(1, -(-now.count() // AT_ONCE))
    now = cut(now.repartition(shares).mapInPandas(_stars, "u long, v long").distinct())
    last = _mark(now) if shares > 1 else None
    while shares > 1:
        now = cut(_small_star(_large_star(now)).distinct())
        mark = _mark(now)
        if mark == last:
            break
        last = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
