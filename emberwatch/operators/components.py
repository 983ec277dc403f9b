"""Connected components of a table of links, without a task that sees one whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link (a, b: numbers), root being the smallest node that can be reached.

    Every round, a node and the root it has so far hear of the least root among the node's neighbours, and take it; then roots are
    replaced by their own roots. So trees are hooked onto each other and flattened, and rounds grow as the logarithm
    of the longest chain. Null ends and loops are ignored. All steps are joins and minima by key.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    links = kept(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = kept(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        near = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("from")), "a").select(F.col("b").alias("node"), "from")
        heard = near.join(roots, "node").select("root", "from").filter(F.col("from") < F.col("root")).groupBy(F.col("root").alias("node")).agg(F.min("from").alias("from"))
        said = near.groupBy("node").agg(F.min("from").alias("from")).unionByName(heard).groupBy("node").agg(F.min("from").alias("from"))
        hooked = kept(roots.join(said, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "from").alias("root")))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = kept(hooked.join(above, "root", "left").select("node", "was", F.least("root", "top").alias("root")))
        roots = now.select("node", "root")
        if not now.filter(F.col("root") < F.col("was")).limit(1).count():
            return roots
