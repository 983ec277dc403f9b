"""Software inventories: components, lock drift, merged bills, size-budget parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised_package, npm_purl, sri_hex
from .budget import numbered


def npm_components(spark: SparkSession, path: str) -> DataFrame:
    """name, version, purl, hash of the packages of npm lock files; each once."""
    raw = spark.read.text(path, wholetext=True)
    packages = F.from_json(F.get_json_object("value", "$.packages"), "map<string,struct<version:string,integrity:string,dev:boolean>>")
    own = raw.select(F.explode(packages).alias("path", "p")).filter("path <> ''")
    name = F.element_at(F.split("path", "node_modules/"), -1)
    out = own.select(name.alias("name"), F.col("p.version").alias("version"), sri_hex(F.col("p.integrity")).alias("hash"), F.coalesce("p.dev", F.lit(False)).alias("dev"))
    return out.withColumn("purl", npm_purl(F.col("name"), F.col("version"))).dropDuplicates(["purl"])


def pins(lines: DataFrame, value: str = "value") -> DataFrame:
    """name, version of `name==version` lines."""
    own = lines.select(normalised_package(F.regexp_extract(value, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*==", 1)).alias("name"), F.regexp_extract(value, r"==\s*([^\s;\\#]+)", 1).alias("version"))
    return own.filter("name <> '' and version <> ''")


def drift(lock: DataFrame, truth: DataFrame) -> DataFrame:
    """name, version, expected of pins that the authoritative lock has otherwise or not at all."""
    own = lock.join(truth.select("name", F.col("version").alias("expected")), "name", "left")
    return own.filter(~F.col("version").eqNullSafe(F.col("expected"))).select("name", "version", "expected")


def ambiguous(lock: DataFrame) -> DataFrame:
    """Packages pinned to more than one version."""
    return lock.groupBy("name").agg(F.countDistinct("version").alias("versions")).filter("versions > 1")


def merged(*bills: DataFrame) -> DataFrame:
    """Components of all bills, each purl once, by purl."""
    out = bills[0]
    for b in bills[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.dropDuplicates(["purl"]).orderBy("purl")


def remapped(vulnerabilities: DataFrame, components: DataFrame) -> DataFrame:
    """vulnerabilities (ref) with ref replaced by the component's purl where its old ref is known."""
    return vulnerabilities.join(components.select("ref", "purl").distinct(), "ref", "left").withColumn("ref", F.coalesce("purl", "ref")).drop("purl")


def parts(items: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """group, order, part: items in order packed one after another; a part ends where the next item would pass the budget.

    Groups of any size are cut among tasks; see budget.numbered.
    """
    return numbered(items, group, order, size, budget)


def digest(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over (name, text) of all files in order of name, each ended by a zero byte."""
    each = F.concat(F.col("name"), F.lit("\x00"), F.col("text"), F.lit("\x00"))
    ordered = F.array_sort(F.collect_list(F.struct("name", each.alias("t"))))
    return files.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), "").cast("binary"), 256).alias("digest"))
