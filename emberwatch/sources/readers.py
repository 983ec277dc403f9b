"""Scans: log lines, whole logs, raw records, document corpora, rule files, vector tables, hash-checked files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parent_name, stripped
from .lines import numbered_lines

SUFFIXES = ("txt", "md", "rst")
MOST_BYTES = 5_000_000
BATCH_LINES = 2000


def log_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """file, idx, raw of the lines that aren't blank, trimmed, idx from 0 in each file, whatever the files' size.

    limit: only the first lines of each file.
    """
    lines = numbered_lines(spark, path)
    return lines if limit is None else lines.filter(F.col("idx") < limit)


def unordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw of lines that aren't blank, where order doesn't matter: large files are split among tasks."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("raw")).filter(F.length("raw") > 0)


def whole_log(spark: SparkSession, path: str) -> DataFrame:
    """raw: each file as one event."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """source (path below root), category (folder), text of text files of at most MOST_BYTES, all folders below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    own = files.filter(F.col("length") <= MOST_BYTES)
    start = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    source = F.regexp_replace(F.expr("replace(path, 'file:', '')"), r"^/+", "/")
    relative = F.when(F.startswith(source, start), F.regexp_replace(F.substring(source, F.length(start) + 1, F.length(source)), "^/", "")).otherwise(source)
    return own.select(relative.alias("source"), F.coalesce(parent_name(relative), F.lit("root")).alias("category"), F.col("content").cast("string").alias("text"))


def by_name(docs: DataFrame) -> DataFrame:
    """docs by file name; of one name the last path."""
    name = F.element_at(F.split("source", "/"), -1)
    return docs.withColumn("name", name).groupBy("name").agg(F.max_by("text", "source").alias("text"), F.max("source").alias("source"))


def checked_bytes(spark: SparkSession, path: str, pins: dict[str, str], most: int = 1 << 20) -> DataFrame:
    """name, content of files whose SHA-256 is as pinned and that aren't larger than `most`; raises for any other."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    table = F.create_map(*[F.lit(x) for kv in pins.items() for x in kv])
    good = (F.col("length") <= most) & F.sha2("content", 256).eqNullSafe(F.element_at(table, F.col("name")))
    return files.filter(F.col("name").isin(list(pins))).select("name", F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not as pinned: "), "name")).cast("binary")).alias("content"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that don't parse are left out (see broken_lines)."""
    return _json(spark, path, schema).filter("_bad is null").drop("_bad", "_metadata")


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, n: lines that jsonl leaves out, by file."""
    own = _json(spark, path, schema).select("_bad", F.col("_metadata.file_path").alias("file"))
    return own.filter("_bad is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # what isn't an object is no record either
    own = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select("value", "_metadata", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return own.select("r.*", "_metadata")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """source, index, char_start, text, vector of a vector table."""
    return spark.read.parquet(path).select("source", "index", "char_start", "text", "vector")
