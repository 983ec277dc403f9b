"""Mapping of classified events to techniques, by rules compiled to columns: every rule is tested in one
projection, without a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..content.mapping_rules import FALLBACK, RULES, TECHNIQUE_NAMES
from ..functions.text import all_of, any_of

RANKS = {"low": 0, "medium": 1, "high": 2}
MOST_RULES = 200


def check_rules(rules: list[dict]) -> None:
    """Raises for a rule set that is too large, has a repeated id, or a field, operator or confidence that isn't known."""
    ids = [r["id"] for r in rules]
    if len(ids) > MOST_RULES or len(set(ids)) < len(ids):
        raise ValueError("too many rules, or an id twice")
    for r in rules:
        for c in r["when"]:
            if set(c) != {"field", "op", "values"} or c["field"] not in ("event_type", "log_text") or c["op"] not in ("equals", "contains_any", "contains_all") or not c["values"]:
                raise ValueError(f"rule {r['id']}: clause {c} isn't known")
        if not r["when"] or not (r["techniques"] or r["legacy"]) or any(t["confidence"] not in RANKS for t in r["techniques"]):
            raise ValueError(f"rule {r['id']} is incomplete")


def clause(c: dict, event_type: Column, log_text: Column) -> Column:
    own = F.lower(event_type if c["field"] == "event_type" else log_text)
    values = [v.lower() for v in c["values"]]
    if c["op"] == "equals":
        return F.coalesce(own.isin(values), F.lit(False))
    return any_of(own, values) if c["op"] == "contains_any" else all_of(own, values)


def rule(r: dict, event_type: Column, log_text: Column) -> Column:
    return reduce(lambda a, b: a & b, [clause(c, event_type, log_text) for c in r["when"]])


def mapped(df: DataFrame, event_type: str = "event_type", log_text: str = "text", rules: list[dict] = RULES, fallback: dict = FALLBACK) -> DataFrame:
    """df with matched_rules (ids), primary (technique_id, tactic, confidence of the first match, or the fallback)
    and techniques (array of id, tactic, confidence; each once, at the place of its first match, with the
    highest confidence of all its matches)."""
    check_rules(rules)
    kind, text = F.col(event_type), F.coalesce(F.col(log_text), F.lit(""))
    hits = [F.when(rule(r, kind, text), F.lit(r["id"])) for r in rules]

    def said(t: dict) -> Column:
        return F.struct(*[F.lit(t[k]).alias(k) for k in ("technique_id", "tactic", "confidence")])

    def merged(every: Column) -> Column:
        ids = F.transform(every, lambda t: t["technique_id"])

        def best(t: Column) -> Column:
            rank = F.array_max(F.transform(F.filter(every, lambda o: o["technique_id"] == t["technique_id"]), lambda o: confidence_rank(o["confidence"])))
            return F.struct(t["technique_id"].alias("technique_id"), t["tactic"].alias("tactic"), F.when(rank == 2, "high").when(rank == 1, "medium").otherwise("low").alias("confidence"))

        return F.transform(F.filter(every, lambda t, i: F.array_position(ids, t["technique_id"]) == i + 1), best)

    def outcome(matched: Column) -> Column:
        first = F.get(matched, F.lit(0))
        primary = reduce(lambda c, r: c.when(first == r["id"], said(r["techniques"][0] if r["techniques"] else r["legacy"])), rules, F.when(F.lit(False), said(fallback))).otherwise(said(fallback))
        table = F.create_map(*[x for r in rules if r["techniques"] for x in (F.lit(r["id"]), F.array(*map(said, r["techniques"])))])
        every = F.flatten(F.array_compact(F.transform(matched, lambda i: F.element_at(table, i))))
        return F.struct(matched.alias("matched_rules"), primary.alias("primary"), F.get(F.transform(F.array(every), merged), F.lit(0)).alias("techniques"))

    # bound by one-element arrays, the tests of the rules stand in the plan once
    df = df.withColumn("__m", F.get(F.transform(F.array(F.array_compact(F.array(*hits))), outcome), F.lit(0)))
    return df.withColumns({c: F.col(f"__m.{c}") for c in ("matched_rules", "primary", "techniques")}).drop("__m")


def rule_techniques(spark: SparkSession, rules: list[dict] = RULES) -> DataFrame:
    """rule_id, technique_id, tactic, confidence: a row per rule and technique."""
    rows = [(r["id"], t["technique_id"], t["tactic"], t["confidence"]) for r in rules for t in r["techniques"]]
    return spark.createDataFrame(rows, "rule_id string, technique_id string, tactic string, confidence string")


def resolved(own: DataFrame, corpus: DataFrame) -> DataFrame:
    """own (technique_id, tactic) with name, url and problem, from corpus (technique_id, name, url, status, tactics).

    The problem is unknown for a technique that the corpus hasn't, its status for one that isn't active, and
    tactic for one that hasn't the tactic; null otherwise.
    """
    known = corpus.select("technique_id", "name", "url", F.col("status").alias("__status"), F.col("tactics").alias("__tactics"))
    out = own.join(known, "technique_id", "left")
    problem = F.when(F.col("__status").isNull(), "unknown").when(F.col("__status") != "active", F.col("__status")).when(~F.coalesce(F.array_contains("__tactics", F.col("tactic")), F.lit(False)), "tactic")
    return out.withColumn("problem", problem).drop("__status", "__tactics")


def check_references(own: DataFrame, corpus: DataFrame) -> DataFrame:
    """resolved rows without a problem; raises if there is one."""
    out = resolved(own, corpus)
    bad = out.filter("problem is not null").limit(5).collect()
    if bad:
        raise ValueError("dead references: " + ", ".join(f"{r['technique_id']} ({r['problem']})" for r in bad))
    return out.drop("problem")


def confidence_rank(label: Column) -> Column:
    return F.when(label == "high", 2).when(label == "medium", 1).otherwise(0)


def technique_name(technique_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TECHNIQUE_NAMES.items() for x in kv])
    return F.element_at(table, technique_id)


def merged_over_rows(mapped_rows: DataFrame, key: str) -> DataFrame:
    """Techniques of all rows of a key: key, technique_id, tactic of the first row (by idx), highest confidence, n rows."""
    # the outer form keeps the optimizer from repeating the mapping in a filter below the explosion
    each = mapped_rows.select(key, "idx", F.posexplode_outer("techniques").alias("pos", "t")).filter("t is not null").select(key, "idx", "pos", "t.*")
    rank = confidence_rank(F.col("confidence"))
    out = each.groupBy(key, "technique_id").agg(F.min(F.struct("idx", "pos", "tactic")).alias("first"), F.max(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "technique_id", F.col("first.tactic").alias("tactic"), F.when(F.col("rank") == 2, "high").when(F.col("rank") == 1, "medium").otherwise("low").alias("confidence"), F.col("first.idx").alias("first_idx"), "n")
