"""Threat intelligence: ranges never to flag, ageing indicators, verdicts, behavioural records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..content import intel_seed as seed
from ..functions.net import in_any, in_v4, in_v6, is_strict_v4, v4_number, v6_bits
from ..functions.text import bound

BASE = {"low": 0.3, "medium": 0.6, "high": 1.0}
FLOOR = 0.15
NETWORK_TYPES = ["ipv4", "ipv6", "domain", "url"]
RISKS = {"benign": 0, "suspicious": 1, "malicious": 2}
INTERNAL = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "fc00::/7"]
MOST_ATOMIC, MOST_BEHAVIORS = 5000, 500


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed.SOURCES, "source_id string, upstream string, retrieved string").withColumn("retrieved", F.to_date("retrieved"))


def atomic(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(seed.ATOMIC, "type string, value string, risk string, confidence string, source_id string, retrieved string, expires string, reference string")
    return df.withColumns({"retrieved": F.to_date("retrieved"), "expires": F.to_date("expires"), "value": F.lower("value")})


def behaviors(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(seed.BEHAVIORS, "behavior_id string, techniques array<string>, event_types array<string>, confidence string, last_reviewed string, review_days int")
    return df.withColumn("last_reviewed", F.to_date("last_reviewed"))


def checked(table: DataFrame, keys: list[str], most: int, known_sources: DataFrame) -> DataFrame:
    """table, after tests on the driver that it isn't too large, repeats no key and names known sources only."""
    if table.count() > most:
        raise ValueError(f"more than {most} records")
    if table.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("a record twice")
    if "source_id" in table.columns and table.join(known_sources, "source_id", "left_anti").limit(1).count():
        raise ValueError("a record of an unknown source")
    return table


def default_as_of(indicators: DataFrame, own_sources: DataFrame) -> Column:
    """The newest retrieval date, as a literal."""
    newest = indicators.select("retrieved").union(own_sources.select("retrieved")).agg(F.max("retrieved")).first()[0]
    return F.lit(newest)


def decayed(kind: Column, confidence: Column, retrieved: Column, expires: Column, as_of: Column) -> Column:
    """Confidence halved once per half-life since retrieval; 0 if expired or retrieved after as_of."""
    half = F.element_at(F.create_map(*[F.lit(x) for kv in seed.HALF_LIVES.items() for x in kv]), kind).cast("double")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), confidence)
    age = F.datediff(as_of, retrieved)
    return F.when((as_of > expires) | (age < 0), 0.0).otherwise(base * F.pow(F.lit(2.0), -age / half))


def band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "medium").when(score >= FLOOR, "low").otherwise("none")


SCOPES = {"private": INTERNAL, "loopback": ["127.0.0.0/8", "::1/128"], "link_local": ["169.254.0.0/16", "fe80::/10"], "multicast": ["224.0.0.0/4", "ff00::/8"]}


def indicator_kind(value: Column) -> Column:
    """private, loopback, link_local, multicast or public for addresses of both versions; domain or unknown otherwise."""
    v = F.lower(F.trim(value))

    def scope(number: Column, test) -> Column:
        return reduce(lambda c, kv: c.when(test(number, kv[1]), kv[0]), list(SCOPES.items())[1:], F.when(test(number, INTERNAL), "private")).otherwise("public")

    four = F.when(is_strict_v4(v), bound(v4_number(v), lambda n: scope(n, in_v4)))
    six = F.when(F.contains(v, F.lit(":")), bound(v6_bits(v), lambda b: F.when(b.isNotNull(), scope(b, in_v6))))
    return F.coalesce(four, six, F.when(F.contains(v, F.lit(".")), "domain").otherwise("unknown"))


def verdicts(values: DataFrame, indicators: DataFrame, own_sources: DataFrame, as_of: Column, *, value: str = "value", never_flag: list[str] = seed.NEVER_FLAG) -> DataFrame:
    """One row per distinct value: needle, risk, confidence, decayed_score, n_sources, sources, refs.

    Suppressed (in a range never to flag), unknown (no record), expired (none live), or the worst risk of the
    live records; malicious needs two upstreams where a network indicator is among them.
    """
    needles = values.select(F.lower(F.trim(F.col(value))).alias("needle")).filter("needle is not null and needle <> ''").distinct()
    needles = needles.withColumn("suppressed", in_any(F.col("needle"), never_flag))
    rows = indicators.join(own_sources.select("source_id", "upstream"), "source_id")
    rows = rows.withColumn("score", decayed(F.col("type"), F.col("confidence"), F.col("retrieved"), F.col("expires"), as_of)).withColumn("live", F.col("score") >= FLOOR)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv]), F.col("risk"))
    live = F.col("live")
    per = rows.groupBy("value").agg(
        F.bool_or(live).alias("any_live"),
        F.max(F.when(live, F.col("score"))).alias("score"),
        F.max(F.when(live, rank)).alias("rank"),
        F.bool_or(live & F.col("type").isin(NETWORK_TYPES)).alias("network"),
        F.countDistinct(F.when(live, F.col("upstream"))).alias("upstreams"),
        F.array_sort(F.collect_set(F.when(live, F.col("source_id")))).alias("live_sources"),
        F.array_sort(F.collect_set("source_id")).alias("all_sources"),
        F.array_sort(F.collect_set(F.when(live, F.col("reference")))).alias("live_refs"),
        F.array_sort(F.collect_set("reference")).alias("all_refs"),
    )
    out = needles.join(per, needles["needle"] == per["value"], "left")
    none = F.array().cast("array<string>")
    capped = (F.col("rank") == 2) & F.col("network") & (F.col("upstreams") < 2)
    risk = F.when(F.col("suppressed"), "suppressed").when(F.col("value").isNull(), "unknown").when(~F.col("any_live"), "expired")
    risk = risk.when(capped, "suspicious").when(F.col("rank") == 2, "malicious").when(F.col("rank") == 1, "suspicious").otherwise("benign")
    out = out.withColumn("risk", risk).withColumn("said", ~F.col("risk").isin("suppressed", "unknown", "expired"))
    own_sources_ = F.when(F.col("said"), F.col("live_sources")).when(F.col("risk") == "expired", F.col("all_sources")).otherwise(none)
    refs = F.when(F.col("said"), F.col("live_refs")).when(F.col("risk") == "expired", F.col("all_refs")).otherwise(none)
    score = F.when(F.col("said"), F.col("score")).otherwise(0.0)
    return out.select("needle", "risk", F.when(F.col("said"), band(F.col("score"))).otherwise("none").alias("confidence"), F.bround(score, 4).alias("decayed_score"), F.size(own_sources_).alias("n_sources"), own_sources_.alias("sources"), refs.alias("refs"), F.coalesce(capped & F.col("said"), F.lit(False)).alias("capped"))


def behavior_status(records: DataFrame, corpus: DataFrame, as_of: Column) -> DataFrame:
    """records with status: stale_anchor if a technique isn't active (corpus: technique_id, status), else review_due
    if the last review is too old, else active."""
    each = records.select("behavior_id", F.explode("techniques").alias("technique_id")).join(F.broadcast(corpus.select("technique_id", F.col("status").alias("anchor"))), "technique_id", "left")
    stale = each.groupBy("behavior_id").agg(F.bool_or(F.coalesce(F.col("anchor") != "active", F.lit(True))).alias("stale"))
    late = F.datediff(as_of, "last_reviewed") > F.col("review_days")
    out = records.join(stale, "behavior_id", "left")
    return out.withColumn("status", F.when(F.coalesce("stale", F.lit(False)), "stale_anchor").when(late, "review_due").otherwise("active")).drop("stale")


def behavior_matches(events: DataFrame, records: DataFrame) -> DataFrame:
    """events joined with the records that name their event type."""
    per_type = records.withColumn("event_type", F.explode("event_types")).drop("event_types")
    return events.join(F.broadcast(per_type), "event_type")
