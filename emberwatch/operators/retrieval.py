"""Retrieval over a text corpus: chunks, rarity-weighted overlap, citations and their check, vector search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import sentences, squeezed, windows
from ..functions.vector import letter_histogram

#: Words that don't count in retrieval. Fixed values.
STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "may", "any", "into", "use", "used", "uses", "per", "via", "not"]
TOKEN = "[a-z0-9]{3,}"
#: Queries and vectors of a search that one group compares, and how many of their scores it holds at a time.
QUERY_BLOCK, VECTOR_SHARE, ROUGH = 8192, 16_384, 1 << 22
#: Distinct terms of queries up to which chunks are cut to them before their terms become rows.
MOST_TERMS = 1000


def terms(text: Column, stopwords: bool = True) -> Column:
    """Distinct terms of a text; citations are weighed with all of them, retrieval without the stopwords."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))
    return F.array_except(own, F.array(*map(F.lit, STOPWORDS))) if stopwords else own


def chunks(docs: DataFrame, source: str = "source", text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """source, index, text, char_start of overlapping character windows."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(source).alias("source"), F.explode(windows(body, size, overlap)).alias("c")).select("source", "c.*")


def _asked_terms(own_chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """source, index, term of chunks, of terms that are asked for; only those leave their row where they are few."""
    own = terms(F.col("text"))
    wanted = [r[0] for r in queries.select(F.explode(terms(F.col("query")))).distinct().limit(MOST_TERMS + 1).collect()]
    if len(wanted) <= MOST_TERMS:
        own = F.array_intersect(own, F.array(*map(F.lit, wanted)).cast("array<string>"))
    return own_chunks.select("source", "index", F.explode(own).alias("term"))


def term_weights(own_chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, term, weight of every query term: ln(1 + N / (1 + df)) over chunks; queries: query_id, query.

    df is counted only for terms that are asked for; terms of the corpus meet those of the queries in one
    hash join after a map-side count.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term"))
    wanted = asked.select("term").distinct()
    df = _asked_terms(own_chunks, queries).select("term").join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = own_chunks.agg(F.count(F.lit(1)).alias("n"))
    out = asked.join(df, "term", "left").crossJoin(F.broadcast(n))  # one row beside
    return out.select("query_id", "term", F.log1p(F.col("n") / (1 + F.coalesce("df", F.lit(0)))).alias("weight"))


def scored_chunks(own_chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, source, index, score, of chunks that share a term with a query.

    Scores are rounded, so that the order in which weights are added up doesn't decide between equals.
    """
    weights = term_weights(own_chunks, queries)
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("total"))
    each = _asked_terms(own_chunks, queries).join(weights, "term")
    own = each.groupBy("query_id", "source", "index").agg(F.sum("weight").alias("own"))
    return own.join(total, "query_id").select("query_id", "source", "index", F.round(F.col("own") / F.col("total"), 12).alias("score"))


def retrieve(own_chunks: DataFrame, queries: DataFrame, k: int = 3, snippet: int = 160) -> DataFrame:
    """query_id, rank, source, score, snippet (start of the source's first chunk) of the k best sources of each query."""
    best = scored_chunks(own_chunks, queries).groupBy("query_id", "source").agg(F.max("score").alias("score")).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    openings = own_chunks.filter("index = 0").select("source", F.substring(squeezed(F.col("text")), 1, snippet).alias("snippet"))
    return top.join(openings, "source", "left").select("query_id", "rank", "source", "score", F.coalesce("snippet", F.lit("")).alias("snippet"))


def best_passage(query: Column, text: Column, most: int = 240) -> Column:
    """The sentence of text that shares most of the query's weight (rarer among the sentences weighs more), cut at a
    blank to `most` characters; the first of equals, and the first at all if none shares a term."""
    # each step is bound to a one-element array, so that what it computes isn't computed again for each sentence
    def with_weights(x: Column) -> Column:
        n = F.size(x["own"]).cast("double")
        weights = F.transform(x["q"], lambda q: F.struct(q.alias("q"), F.log1p(n / (1 + F.size(F.filter(x["own"], lambda o: F.array_contains(o["t"], q))))).alias("w")))
        return F.struct(x["own"].alias("own"), weights.alias("weights"))

    def best(x: Column) -> Column:
        def score(o: Column, i: Column) -> Column:
            shared = F.aggregate(F.filter(x["weights"], lambda w: F.array_contains(o["t"], w["q"])), F.lit(0.0), lambda a, w: a + w["w"])
            return F.struct(shared.alias("score"), (-i).alias("neg"), o["s"].alias("s"))

        return F.array_max(F.transform(x["own"], score))["s"]

    own = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), terms(s, stopwords=False).alias("t")))
    start = F.array(F.struct(own.alias("own"), terms(query, stopwords=False).alias("q")))
    quote = F.get(F.transform(F.transform(start, with_weights), best), F.lit(0))
    cut = F.substring(quote, 1, most)
    at_blank = F.rtrim(F.regexp_extract(cut, "(?s)^(.*) [^ ]*$", 1))
    return F.when(F.length(quote) > most, F.coalesce(F.nullif(at_blank, F.lit("")), cut)).otherwise(quote)


def citations(own_chunks: DataFrame, queries: DataFrame, *, per_source: int = 1, k: int = 3, most: int = 240) -> DataFrame:
    """query_id, rank, source, score, quote, char_start, char_end: quotes stand in their sources at those places."""
    scored = scored_chunks(own_chunks, queries).filter("score > 0")
    capped = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "index"))).filter(F.col("n") <= per_source)
    top = capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "index"))).filter(F.col("rank") <= k)
    full = top.join(own_chunks, ["source", "index"]).join(queries, "query_id").withColumn("quote", best_passage(F.col("query"), F.col("text"), most))
    full = full.withColumn("at", F.expr("locate(quote, text)")).filter("at > 0 and length(quote) > 0")
    start = F.col("char_start") + F.col("at") - 1
    return full.select("query_id", "rank", "source", F.bround("score", 4).alias("score"), "quote", start.alias("char_start"), (start + F.length("quote")).alias("char_end"))


def verified(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """cited with valid: whether the source (source, text) holds the quote at its place."""
    own = cited.join(sources.select("source", F.col("text").alias("__text")), "source", "left")
    same = (F.col("char_start") >= 0) & (F.length("quote") > 0) & (F.expr("substring(__text, char_start + 1, char_end - char_start)") == F.col("quote"))
    return own.withColumn("valid", F.coalesce(same, F.lit(False))).drop("__text")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 3, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: exact cosine top k of stated queries (query_id, query).

    Every query meets every vector: shares of about VECTOR_SHARE vectors meet blocks of about QUERY_BLOCK queries, each pair of them in a group
    of its own, which returns its k best. Scores order as rounded to nine digits, then by key, so that the way in which they are added up
    doesn't decide between equals. Scores of null vectors, or of those that hold a null, are null and come last, of zero vectors 0; vectors
    of several dimensions raise.
    """
    shares, blocks = (max(1, -(-df.count() // most)) for df, most in ((vectors, VECTOR_SHARE), (queries, QUERY_BLOCK)))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one_of(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    asked = queries.select("query_id", F.col("query").alias("vector"), one_of("query_id", blocks).alias("block"), all_of(shares).alias("share"))
    own = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), all_of(blocks).alias("block"), one_of(key, shares).alias("share"))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("key", vectors.schema[key].dataType), StructField("score", DoubleType())])
    found = asked.groupBy("share", "block").cogroup(own.groupBy("share", "block")).applyInArrow(_nearest(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros where one is null or holds a null, and which ones these aren't."""
    own = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(own).drop_null().unique().to_pylist()
    if len(sizes) > 1:
        raise ValueError("vector dimensions differ")
    valid = own.is_valid().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(own), sizes[0] if sizes else 0))
    values = own.flatten()
    rows[valid] = values.to_numpy(zero_copy_only=False).reshape(valid.sum(), rows.shape[1])
    if values.null_count:
        valid[valid] = values.is_valid().to_numpy(zero_copy_only=False).reshape(valid.sum(), rows.shape[1]).all(axis=1)
        rows[~valid] = 0
    return rows, valid


def _nearest(k: int):
    """The k best of a share of vectors for each of a block of queries; those that one matrix product finds are scored again, in a fixed order."""

    def lengths(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for column in rows.T:
            total += column * column
        return np.sqrt(total)

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        queries, said = _matrix(asked["vector"])
        vectors, whole = _matrix(own["vector"])
        if said.any() and whole.any() and queries.shape[1] != vectors.shape[1]:
            raise ValueError("vector dimensions differ")
        keys = pa.table({"key": own["key"]})
        while any(pa.types.is_struct(f.type) for f in keys.schema):
            keys = keys.flatten()
        keys = keys.rename_columns([str(i) for i in range(keys.num_columns)])
        place = np.empty(len(own), np.int64)  # of keys, in their order
        place[pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()] = np.arange(len(own))
        by_key = np.argsort(place)
        q, v, score, size, norm = [], [], [], lengths(queries), lengths(vectors)
        full, none = by_key[whole[by_key]], by_key[~whole[by_key]][:k]
        some = min(k, len(full))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = vectors[full] / np.where(norm[full] > 0, norm[full], 1)[:, None]
            for at in np.array_split(np.flatnonzero(said), max(1, said.sum() * len(full) // ROUGH)) if some and said.any() else []:
                rough = (queries[at] / np.where(size[at] > 0, size[at], 1)[:, None]) @ unit.T
                rough[np.isnan(rough)] = np.inf
                least = np.partition(rough, len(full) - some, axis=1)[:, len(full) - some]
                i, j = np.nonzero(rough >= least[:, None] - 1e-8)
                i, j = at[i], full[j]
                both, dots = size[i] * norm[j], np.zeros(len(i))
                for a, b in zip(queries.T, vectors.T, strict=True):
                    dots += a[i] * b[j]
                exact = np.where(both == 0, 0.0, dots / both)
                scaled = np.abs(exact) * 1e9
                rank = np.where(np.isnan(exact), np.inf, np.copysign(np.floor(scaled + 0.5), exact))
                order = np.lexsort((place[j], -rank, i))
                i, j, exact = i[order], j[order], exact[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < some
                q, v, score = [*q, i[best]], [*v, j[best]], [*score, exact[best]]
        # without a score: vectors that are null, where there are too few others, and all of them for a query that is null
        for i, rest in ((np.flatnonzero(said), none[: k - some]), (np.flatnonzero(~said), by_key[:k])):
            q, v, score = [*q, np.repeat(i, len(rest))], [*v, np.tile(rest, len(i))], [*score, np.full(len(i) * len(rest), np.nan)]
        unscored = np.repeat([False, True], [sum(map(len, score[:-2])), sum(map(len, score[-2:]))])
        q, v = np.concatenate(q).astype(np.int64), np.concatenate(v).astype(np.int64)
        return pa.table({"query_id": asked["query_id"].take(pa.array(q)), "key": own["key"].take(pa.array(v)), "score": pa.array(np.concatenate(score), mask=unscored)})

    return run


def embedded(own_chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """chunks with vector: the offline embedding of their text, or what embed makes of each batch of texts.

    embed runs on the executors, a batch of rows at a time (a service it asks has to be within their reach); it
    raises if it returns another number of vectors, or vectors of several lengths.
    """
    if embed is None:
        return own_chunks.withColumn("vector", letter_histogram(F.col("text")))

    @F.pandas_udf("array<double>")
    def said(texts: pd.Series) -> pd.Series:
        own = embed(list(texts))
        if len(own) != len(texts) or len({len(v) for v in own}) > 1:
            raise ValueError("one vector a text, all of the same length")
        return pd.Series([[float(x) for x in v] for v in own], index=texts.index)

    return own_chunks.withColumn("vector", said("text"))


def search(own_chunks: DataFrame, vectors: DataFrame | None, query: str, k: int = 5, *, category: str | None = None) -> DataFrame:
    """rank, source, score, snippet, backend: vector search where there are vectors, else by terms.

    category: only sources in that folder, filtered before the best are taken.
    """
    spark = own_chunks.sparkSession

    def wanted(df: DataFrame) -> DataFrame:
        return df if category is None else df.filter(F.get(F.reverse(F.split("source", "/")), F.lit(1)) == category)

    if vectors is not None and vectors.limit(1).count():
        asked = spark.createDataFrame([(1, query)], "query_id int, text string").select("query_id", letter_histogram(F.col("text")).alias("query"))
        rows = wanted(vectors).withColumn("key", F.struct("source", "index"))
        found = vector_search(rows, asked, k, key="key", vector="vector")
        texts = rows.select("key", F.substring(squeezed(F.col("text")), 1, 160).alias("snippet"))
        return found.join(texts, "key").select("rank", "key.source", "score", "snippet", F.lit("vector").alias("backend"))
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    return retrieve(wanted(own_chunks), asked, k).select("rank", "source", "score", "snippet", F.lit("lexical").alias("backend"))
