"""Detection rules behind techniques, patterns and behaviours. Rule tables are small and given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..content.sigma_rules import PATTERN_TECHNIQUES
from .sigma import level_rank, techniques


def rule_table(spark: SparkSession, rules: list[dict], kind: str) -> DataFrame:
    """rule_id, title, level, kind, technique_id: a row per rule and technique in its tags."""
    rows = [(r["name"], r.get("title", r["name"].replace("_", " ")), r["level"], kind, t) for r in rules for t in techniques(r["tags"])]
    return spark.createDataFrame(rows, "rule_id string, title string, level string, kind string, technique_id string")


def for_techniques(found: DataFrame, rules: DataFrame) -> DataFrame:
    """found (any columns, technique_id) joined with its rules; rank orders them by level and title."""
    return found.join(F.broadcast(rules), "technique_id").withColumn("level_rank", level_rank(F.col("level")))


def rules_of(found: Column, rules: list[dict]) -> Column:
    """Rules behind an array of techniques, as an array of (level_rank, title, rule_id, level), worst level first.

    Rules are given as literals, a few dozen at most, so that events need neither a join nor a shuffle.
    """
    per: dict[str, list[dict]] = {}
    for r in rules:
        for t in techniques(r["tags"]):
            per.setdefault(t, []).append(r)

    def said(r: dict) -> Column:
        title = r.get("title", r["name"].replace("_", " "))
        return F.struct(level_rank(F.lit(r["level"])).alias("level_rank"), F.lit(title).alias("title"), F.lit(r["name"]).alias("rule_id"), F.lit(r["level"]).alias("level"))

    table = F.create_map(*[x for t, own in sorted(per.items()) for x in (F.lit(t), F.array(*map(said, own)))])
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(found, lambda t: F.element_at(table, t))))))


def first_per_rule(matches: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's matches of one rule the first, in the order of columns given."""
    best = matches.groupBy(key, "rule_id").agg(F.min(F.struct(*order, *[c for c in matches.columns if c not in (key, "rule_id", *order)])).alias("m"))
    return best.select(key, "rule_id", "m.*")


def for_findings(findings: DataFrame, correlation_rules: DataFrame) -> DataFrame:
    """Correlation rules that share a technique with a finding's pattern, once per sequence and rule."""
    spark = findings.sparkSession
    bridge = spark.createDataFrame([(p, t) for p, own in PATTERN_TECHNIQUES.items() for t in own], "pattern string, technique_id string")
    joined = findings.select("sequence_id", "pattern", "source", "block").join(F.broadcast(bridge), "pattern").join(F.broadcast(correlation_rules), "technique_id")
    once = first_per_rule(joined, "sequence_id", ["block", "source", "pattern", "technique_id"])
    return once.withColumn("level_rank", level_rank(F.col("level")))


def ranked(matches: DataFrame, key: str) -> DataFrame:
    """matches with place: critical first, then by title and rule."""
    order = Window.partitionBy(key).orderBy("level_rank", "title", "rule_id")
    return matches.withColumn("place", F.row_number().over(order))


def uncovered(rules: DataFrame, fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules without a fixture, and fixtures without a rule."""
    return rules.select("rule_id").distinct().join(fixtures, "rule_id", "left_anti"), fixtures.join(rules, "rule_id", "left_anti")


def coverage(rules: DataFrame) -> DataFrame:
    """technique_id, n_rules, titles (sorted, each once) and share of the largest count."""
    per = rules.groupBy("technique_id").agg(F.countDistinct("rule_id").alias("n_rules"), F.array_sort(F.collect_set("title")).alias("titles"))
    most = per.agg(F.max("n_rules").alias("most"))
    return per.crossJoin(F.broadcast(most)).withColumn("share", F.col("n_rules") / F.col("most")).drop("most")  # one row beside


def navigator_layer(rules: DataFrame, corpus: DataFrame, name: str, version: str) -> DataFrame:
    """layer: one JSON text, a layer that scores each technique by the number of its rules and names them.

    corpus: technique_id, name, status; raises for a technique that isn't active there. A layer has as many
    entries as there are techniques, which bounds its one row.
    """
    live = corpus.select("technique_id", F.col("name").alias("known"), "status")
    per = coverage(rules).join(live, "technique_id", "left")
    checked = F.when(F.col("status").eqNullSafe(F.lit("active")), F.col("technique_id")).otherwise(F.raise_error(F.concat(F.lit("dead reference: "), "technique_id")).cast("string"))
    said = F.concat(F.lit("Detected by: "), F.array_join("titles", "; "), F.lit(" - "), F.col("known"))
    entry = F.struct(checked.alias("techniqueID"), F.col("n_rules").alias("score"), said.alias("comment"), F.lit(True).alias("enabled"))
    all_of = per.agg(F.array_sort(F.collect_list(entry)).alias("techniques"), F.coalesce(F.max("n_rules"), F.lit(1)).alias("most"))
    gradient = F.struct(F.array(F.lit("#ffe766"), F.lit("#ff6666")).alias("colors"), F.lit(0).alias("minValue"), F.col("most").alias("maxValue"))
    versions = F.struct(F.lit(version).alias("attack"), F.lit("4.5").alias("layer"))
    return all_of.select(F.to_json(F.struct(F.lit(name).alias("name"), versions.alias("versions"), F.lit("enterprise-attack").alias("domain"), F.lit(3).alias("sorting"), gradient.alias("gradient"), "techniques")).alias("layer"))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """layer, n: the number of rows of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
