"""Vulnerability findings ranked for repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base score and repair window of each priority. Fixed values.
BASE = {"critical": 90, "high": 70, "medium": 45, "low": 20, "unknown": 10}
WINDOWS = {"critical": "24-48 hours", "high": "within 7 days", "medium": "within 30 days", "low": "within 90 days", "unknown": "triage to assign a severity first"}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def priority(cvss: Column, severity: Column) -> Column:
    """By CVSS from 0 to 10, else by a known severity, else unknown."""
    said = F.lower(F.trim(severity))
    band = F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").otherwise("low")
    return F.when(cvss.between(0, 10), band).when(said.isin(list(BASE)), said).otherwise("unknown")


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "1"), F.lit(False))


def assessed(findings: DataFrame) -> DataFrame:
    """findings (id, cvss, severity, asset, exploit_available, exposed) with priority, score, repair window and place-giving id."""
    rank = priority(F.col("cvss"), F.col("severity"))
    score = _lookup(BASE, F.col("priority")) + F.when(truth(F.col("exploit_available")), 15).otherwise(0) + F.when(truth(F.col("exposed")), 10).otherwise(0)
    out = findings.withColumns({"id": F.coalesce(F.nullif("id", F.lit("")), F.lit("UNKNOWN-ID")), "asset": F.coalesce(F.nullif("asset", F.lit("")), F.lit("unspecified-asset")), "priority": rank})
    return out.withColumns({"score": F.least(F.lit(100), score).cast("int"), "window": _lookup(WINDOWS, F.col("priority"))})


def ranked(findings: DataFrame, top: int | None = None) -> DataFrame:
    """assessed findings, highest score first, then by id; top: only so many, by a distributed top-k."""
    out = assessed(findings).orderBy(F.desc("score"), "id", "asset")
    return out if top is None else out.limit(top)


def counts(findings: DataFrame) -> DataFrame:
    """n of every priority, zeros included."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(k, i) for i, k in enumerate(BASE)], "priority string, place int")
    n = assessed(findings).groupBy("priority").count()
    return every.join(n, "priority", "left").select("priority", F.coalesce("count", F.lit(0)).alias("n"))


def per_asset(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k highest findings of each asset."""
    order = Window.partitionBy("asset").orderBy(F.desc("score"), "id")
    return assessed(findings).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
