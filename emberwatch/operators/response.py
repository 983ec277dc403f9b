"""Response plans: which actions techniques propose, with prerequisites, for each target. Plans are never run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..content.response import ACTIONS, ALIASES, ALWAYS, MITIGATIONS, TECHNIQUE_ACTIONS
from ..functions.text import sanitised_target

DEFAULT_TARGET = "affected-host"


def catalogue(spark: SparkSession) -> DataFrame:
    schema = "action_id string, tier int, verb string, action_class string, reversible boolean, destroys_evidence boolean, owner string, prerequisites array<string>"
    return spark.createDataFrame(ACTIONS, schema)


def bridge(spark: SparkSession) -> DataFrame:
    """technique_id, action_id: the actions of a technique, their prerequisites (one level) and the one that always comes."""
    need = {a[0]: a[-1] for a in ACTIONS}
    rows = {(t, x) for t, own in TECHNIQUE_ACTIONS.items() for a in own for x in (a, *need[a], ALWAYS)}
    return spark.createDataFrame(sorted(rows), "technique_id string, action_id string")


def plans(techniques: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """One row per key, action and target, with place (tier, action, target), from (key, technique_id) and (key, target).

    Keys none of whose techniques propose anything have no plan; keys without a target get the default one.
    """
    spark = techniques.sparkSession
    actions = techniques.select(key, "technique_id").join(F.broadcast(bridge(spark)), "technique_id").select(key, "action_id").distinct()
    own = targets.select(key, F.nullif(sanitised_target(F.col("target")), F.lit("")).alias("target")).filter("target is not null").distinct()
    rows = actions.join(own, key, "left").withColumn("target", F.coalesce("target", F.lit(DEFAULT_TARGET)))
    rows = rows.join(F.broadcast(catalogue(spark)), "action_id")
    order = Window.partitionBy(key).orderBy("tier", "action_id", "target")
    return rows.withColumn("place", F.row_number().over(order))


def plan_of(techniques: Column, source: Column) -> Column:
    """The plan of an event as an array of (tier, action_id, owner, reversible, destroys_evidence, target), in order, from
    its techniques (array of ids) and its source; empty if none of the techniques proposes anything.

    The catalogue is a few literals, so that plans of events need neither a join nor a shuffle.
    """
    need = {a[0]: a[-1] for a in ACTIONS}
    own = {t: sorted({x for a in ids for x in (a, *need[a], ALWAYS)}) for t, ids in TECHNIQUE_ACTIONS.items()}
    proposed = F.create_map(*[x for t, ids in own.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))])
    said = {a[0]: F.struct(F.lit(a[1]).alias("tier"), F.lit(a[0]).alias("action_id"), F.lit(a[6]).alias("owner"), F.lit(a[4]).alias("reversible"), F.lit(a[5]).alias("destroys_evidence")) for a in ACTIONS}
    table = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)])
    ids = F.array_distinct(F.flatten(F.array_compact(F.transform(techniques, lambda t: F.element_at(proposed, t)))))
    target = F.coalesce(F.nullif(sanitised_target(source), F.lit("")), F.lit(DEFAULT_TARGET))
    return F.transform(F.array_sort(F.transform(ids, lambda i: F.element_at(table, i))), lambda a: a.withField("target", target))


def plan_ids(techniques: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """key, plan_id: 16 hexadecimal digits over the sorted techniques and targets, the same for the same plan."""
    t = techniques.groupBy(key).agg(F.array_sort(F.collect_set("technique_id")).alias("t"))
    g = targets.groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("g"))
    parts = F.concat("t", F.array(F.lit("|")), F.coalesce("g", F.array(F.lit(DEFAULT_TARGET))))
    joined = F.concat(F.array_join(parts, "\x00"), F.lit("\x00"))
    return t.join(g, key, "left").select(key, F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("plan_id"))


def mitigations(rows: DataFrame, capability: str = "capability") -> DataFrame:
    """rows with primary (the capability an alias stands for), mitigation_id and mitigation; null for unknown ones."""
    spark = rows.sparkSession
    aliases = spark.createDataFrame(list(ALIASES.items()), "__alias string, __primary string")
    table = spark.createDataFrame([(k, *v) for k, v in MITIGATIONS.items()], "primary string, mitigation_id string, mitigation string")
    own = rows.join(F.broadcast(aliases), F.col(capability) == F.col("__alias"), "left").withColumn("primary", F.coalesce("__primary", F.col(capability)))
    return own.drop("__alias", "__primary").join(F.broadcast(table), "primary", "left")
