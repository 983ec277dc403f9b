"""Compliance posture: control results, attestations, roll-ups by framework and category, trends, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lines import tail_lines

#: Statuses of a control result; manual ones don't count as automated. Fixed values.
STATUSES = ["pass", "fail", "error", "attested", "manual"]
PASSING = ["pass", "attested"]
AUTOMATED = ["pass", "fail", "error"]


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even; 0 of nothing is 0."""
    return F.when(whole == 0, 0).otherwise(F.bround(100 * part / whole, 0)).cast("int")


def with_attestations(controls: DataFrame, attestations: DataFrame, as_of: Column) -> DataFrame:
    """controls (control_id, checked status or null for manual ones) with status: a manual control with an
    attestation valid on as_of (both ends included) is attested, others stay manual."""
    own = attestations.select("control_id", F.col("date").alias("__from"), F.col("expires").alias("__to"), "attested_by")
    newest = own.groupBy("control_id").agg(F.max(F.struct("__to", "__from", "attested_by")).alias("a"))
    joined = controls.join(newest, "control_id", "left")
    valid = F.coalesce(as_of.between(F.col("a.__from"), F.col("a.__to")), F.lit(False))
    status = F.coalesce(F.col("checked"), F.when(valid, "attested").otherwise("manual"))
    detail = F.when(F.col("checked").isNull(), F.when(valid, F.col("a.attested_by")).when(F.col("a").isNotNull(), "attestation expired").otherwise("needs attestation"))
    return joined.withColumns({"status": status, "attestation": detail}).drop("a")


def score(results: DataFrame) -> DataFrame:
    """passing, total, percent over automated controls; one row."""
    automated = F.col("status").isin(AUTOMATED)
    out = results.agg(F.count_if(automated & F.col("status").isin(PASSING)).alias("passing"), F.count_if(automated).alias("total"))
    return out.withColumn("percent", percent(F.col("passing"), F.col("total")))


def by_framework(results: DataFrame) -> DataFrame:
    """framework, passing, total, percent: a control counts once per framework however many references it has."""
    each = results.select("status", F.explode(F.array_distinct("frameworks")).alias("framework"))
    out = each.groupBy("framework").agg(F.count_if(F.col("status").isin(PASSING)).alias("passing"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", percent(F.col("passing"), F.col("total")))


def by_category(results: DataFrame) -> DataFrame:
    out = results.groupBy("category").agg(F.count_if(F.col("status").isin(PASSING)).alias("passing"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", percent(F.col("passing"), F.col("total")))


def tally(results: DataFrame, statuses: list[str] = STATUSES) -> DataFrame:
    """n of every status, zeros included."""
    every = results.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(results.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def trend(evidence: DataFrame, last: int | None = None) -> DataFrame:
    """recorded_at, passing, total, percent per run, in order of time; last: only the newest runs."""
    own = evidence.filter(F.col("status").isin(AUTOMATED))
    out = own.groupBy("recorded_at").agg(F.count_if(F.col("status") == "pass").alias("passing"), F.count(F.lit(1)).alias("total"))
    out = out.withColumn("percent", percent(F.col("passing"), F.col("total")))
    return out.orderBy("recorded_at") if last is None else out.orderBy(F.desc("recorded_at")).limit(last).orderBy("recorded_at")


def missing(results: DataFrame, required: list[str], key: str = "control_id") -> DataFrame:
    """Required names without a row."""
    every = results.sparkSession.createDataFrame([(r,) for r in required], f"{key} string")
    return every.join(results.select(key).distinct(), key, "left_anti")


def bundle(results: DataFrame, generated_at: str) -> DataFrame:
    """bundle: one JSON text for auditors with the score, all controls by id and the roll-ups by framework.

    results: control_id, title, category, severity, status, detail, frameworks (array). Controls are a few dozen; the
    one row grows with them only.
    """
    control = F.struct(F.col("control_id").alias("id"), "title", "category", "severity", "status", "detail", F.array_sort("frameworks").alias("frameworks"))
    controls = results.agg(F.array_sort(F.collect_list(control)).alias("controls"))
    rolled = by_framework(results).agg(F.array_sort(F.collect_list(F.struct("framework", "passing", "total", "percent"))).alias("framework_rollups"))
    one = score(results).crossJoin(F.broadcast(controls)).crossJoin(F.broadcast(rolled))  # a row each
    said = F.struct(F.lit(generated_at).alias("generated_at"), F.col("percent").alias("score"), "passing", F.col("total").alias("automated_total"), "controls", "framework_rollups", F.lit("Evidence of automated checks; no audit or certification.").alias("disclaimer"))
    return one.select(F.to_json(said, {"ignoreNullFields": "false"}).alias("bundle"))


EVIDENCE = ["recorded_at", "control_id", "title", "category", "severity", "status", "detail"]


def record_run(results: DataFrame, path: str, recorded_at: str) -> None:
    """Appends a line per control to an evidence folder (JSON lines)."""
    rows = results.withColumn("recorded_at", F.lit(recorded_at))
    have = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EVIDENCE]
    rows.select(*have).write.mode("append").option("ignoreNullFields", "false").json(path)


def run_summary(results: DataFrame, recorded_at: str) -> DataFrame:
    """The audit event of a run: one row of timestamp, actor, action, action_class, decision (pass where all automated controls
    pass, else attention) and reason."""
    n, passing = F.col("total"), F.col("passing")
    said = {"timestamp": F.lit(recorded_at), "actor": F.lit("compliance-engine"), "action": F.lit("compliance_run"), "action_class": F.lit("read_only")}
    said |= {"decision": F.when(passing == n, "pass").otherwise("attention"), "reason": F.format_string("%d/%d automated controls passing", passing, n)}
    return score(results).select(*[c.alias(name) for name, c in said.items()])


def load_evidence(spark, path: str, newest: int | None = None) -> DataFrame:
    """Evidence rows that have just the fields they should; newest: only so many, newest first, of the last megabyte, which
    alone is read then."""
    if newest is not None and newest <= 0:
        raise ValueError("newest has to be positive")
    raw = spark.read.text(path).filter(F.length(F.trim("value")) > 0) if newest is None else tail_lines(spark, path).withColumnRenamed("raw", "value")
    keys = F.array_sort(F.json_object_keys("value"))
    own = raw.filter(keys == F.array(*map(F.lit, sorted(EVIDENCE)))).select(F.from_json("value", ", ".join(f"{c} string" for c in EVIDENCE)).alias("r")).select("r.*")
    return own if newest is None else own.orderBy(F.desc("recorded_at"), "control_id").limit(newest)


def upsert(attestations: DataFrame, new: DataFrame) -> DataFrame:
    """attestations with those of new in place of older ones of the same control, by control."""
    kept = attestations.join(new.select("control_id").distinct(), "control_id", "left_anti")
    return kept.unionByName(new).orderBy("control_id")
