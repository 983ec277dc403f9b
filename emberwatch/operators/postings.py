"""A stored index of postings for retrieval: appended to by loads, asked without reading the corpus again.

An index is a folder of three Parquet tables: postings (term, source, index; by bucket of the term's hash, sorted by term),
counts (term, df and, with a null term, the number of chunks of each load) and openings (source, snippet).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..functions.text import squeezed
from .retrieval import terms

#: Folders of postings by the hash of their term. An index keeps the number it was begun with.
BUCKETS = 64
#: Distinct terms of queries up to which they are broadcast and their buckets named in the plan.
MOST_TERMS = 10_000
#: Two scores that differ by less count as equal when postings are skipped; retrieval rounds scores to twelve places.
EPSILON = 1e-9
#: The tables of an index, stated so that empty ones can be read.
SCHEMAS = {"postings": "term string, source string, index int, bucket int", "counts": "term string, n long", "openings": "source string, snippet string"}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def append(chunks: DataFrame, path: str, *, snippet: int = 160) -> None:
    """Adds chunks (source, index, text) to the index in path. A chunk is added once: loads don't replace each other.

    Terms are counted within their tasks before they are shuffled; a term of any frequency is spread by its chunks among the
    files of its bucket.
    """
    chunks = chunks.select(F.col("source").cast("string"), F.col("index").cast("int"), "text")
    own = chunks.select("source", "index", F.explode(terms(F.col("text"))).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    spread = F.pmod(F.xxhash64("source", "index"), F.lit(8))
    own.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    number = chunks.agg(F.lit(None).cast("string").alias("term"), F.count(F.lit(1)).alias("n"))
    own.groupBy("term").agg(F.count(F.lit(1)).alias("n")).unionByName(number).write.mode("append").parquet(f"{path}/counts")
    openings = chunks.filter("index = 0").select("source", F.substring(squeezed(F.col("text")), 1, snippet).alias("snippet"))
    openings.write.mode("append").parquet(f"{path}/openings")


def weighted(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id, term, weight, df of the terms of queries (query_id, query): ln(1 + N / (1 + df)) over the chunks of all loads."""
    counts = _table(spark, path, "counts")
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term"))
    n = counts.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    df = counts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    out = asked.join(df, "term", "left").crossJoin(F.broadcast(n)).withColumn("df", F.coalesce("df", F.lit(0)))  # one row beside
    return out.select("query_id", "term", F.log1p(F.col("total") / (1 + F.col("df"))).alias("weight"), "df")


def _of(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Postings of the terms that are asked for, with what asked says of them: only their buckets are read, if they are few."""
    postings = _table(spark, path, "postings")
    names = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(names) > MOST_TERMS:
        return postings.join(asked, "term").drop("bucket")
    buckets = {r[0] for r in spark.createDataFrame([(t,) for t in names], "term string").select(_bucket(F.col("term"))).distinct().collect()}
    return postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(names)).join(F.broadcast(asked), "term").drop("bucket")


def scores(spark: SparkSession, path: str, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, source, score of at least the k best sources of each query, as retrieval.scored_chunks has them.

    A query's terms are taken from the rarest on. The chunks of the rarest terms (of those up to the first k sources or so) give a score that the
    k-th source has at least. Terms that weigh less, all together, than that can't bring in a chunk by themselves: their
    postings count only for chunks that the others have found, and only for those that could still reach it.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    asked = weighted(spark, path, queries)
    asked = asked.withColumns({
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "before": F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).filter("df > 0")
    asked = kept(asked)
    # a source may have many chunks among the first, so more than k are taken
    seeds = _of(spark, path, asked.filter(F.col("before") < 50 * k).select("query_id", "term", "weight"))
    least = _partial(seeds).groupBy("query_id", "source").agg(F.max("own").alias("own"))
    best = Window.partitionBy("query_id").orderBy(F.desc("own"))
    # where there are fewer sources than k among the seeds, nothing is skipped
    least = least.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("own").alias("least"))
    asked = kept(asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - EPSILON))
    needed = F.col("rest") >= F.col("least")
    left = asked.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~needed, F.col("weight"))), F.lit(0.0)).alias("left"), F.first("total").alias("total"), F.first("least").alias("least"))
    found = _partial(_of(spark, path, asked.filter(needed).select("query_id", "term", "weight")))
    found = kept(found.join(left, "query_id").filter(F.col("own") + F.col("left") >= F.col("least")))
    more = _of(spark, path, asked.filter(~needed).select("query_id", "term", "weight"))
    more = more.join(found.select("query_id", "source", "index"), ["query_id", "source", "index"], "left_semi")
    whole = _partial(reduce(DataFrame.unionByName, [found.select("query_id", "source", "index", F.col("own").alias("weight")), more.drop("term")]))
    out = whole.join(left, "query_id").select("query_id", "source", F.round(F.col("own") / F.col("total"), 12).alias("score"))
    return out.groupBy("query_id", "source").agg(F.max("score").alias("score"))


def _partial(postings: DataFrame) -> DataFrame:
    return postings.groupBy("query_id", "source", "index").agg(F.sum("weight").alias("own"))


def retrieve(spark: SparkSession, path: str, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, source, score, snippet of the k best sources of each query, as retrieval.retrieve over all chunks."""
    best = scores(spark, path, queries, k).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    openings = _table(spark, path, "openings").groupBy("source").agg(F.min("snippet").alias("snippet"))
    return top.join(openings, "source", "left").select("query_id", "rank", "source", "score", F.coalesce("snippet", F.lit("")).alias("snippet"))
