"""Sinks: vector tables, keyed overwrite, canonical JSON, reports as text files."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import uuid5


def write_vectors(chunks: DataFrame, path: str) -> None:
    """Appends source, index, char_start, text, vector; raises where vectors differ in dimension, from each other or from
    those that the folder holds."""
    sizes = {r[0] for r in chunks.select(F.size("vector")).distinct().limit(2).collect()}
    try:
        held = chunks.sparkSession.read.parquet(path).select(F.size("vector")).limit(1).collect()
    except AnalysisException:  # nothing is there yet
        held = []
    if len(sizes | {r[0] for r in held}) > 1:
        raise ValueError("vectors of more than one dimension")
    chunks.select("source", "index", "char_start", "text", F.col("vector").cast("array<float>").alias("vector")).write.mode("append").parquet(path)


def point_id(source: Column, index: Column) -> Column:
    """The same id (version 5, of source:index) for the same chunk: writing again replaces instead of adding."""
    return uuid5(uuid.NAMESPACE_URL, F.concat_ws(":", source, index.cast("string")))


def keyed_overwrite(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key isn't in new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


#: Rows of a file that is compared as a whole; json_lines() is for more.
MOST_CANONICAL = 100_000


def canonical(rows: DataFrame, *order: str) -> str:
    """Rows (few) as JSON text with sorted keys, in order of columns, for files that are compared; raises for more than
    MOST_CANONICAL rows, so that no file is cut."""
    own = [r.asDict(recursive=True) for r in rows.orderBy(*order).limit(MOST_CANONICAL + 1).collect()]
    if len(own) > MOST_CANONICAL:
        raise ValueError(f"more than {MOST_CANONICAL} rows")
    return json.dumps(own, indent=2, sort_keys=True, default=str) + "\n"


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def reports(df: DataFrame, path: str) -> None:
    """report texts, a file per partition, one after another."""
    df.select(F.col("report").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)
