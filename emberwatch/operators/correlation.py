"""Sigma correlation rules run over event time: event counts, and one event after another, within a timespan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sigma import RuleError

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def seconds(timespan: str) -> int:
    m = re.fullmatch(r"(\d+)([smhd])", str(timespan))
    if not m:
        raise RuleError(f"timespan {timespan!r} isn't understood")
    return int(m[1]) * UNITS[m[2]]


def _keyed(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose group keys and time are all there; others can't correlate."""
    for k in [*keys, "ts"]:
        events = events.filter(F.col(k).isNotNull())
    return events.withColumn("__s", F.col("ts").cast("timestamp").cast("double"))


def event_count(events: DataFrame, hit: Column, keys: list[str], timespan: str, least: int) -> DataFrame:
    """Matching events at which the matches of their group within the trailing timespan (inclusive) reach `least`.

    Adds match_count. A hot group would be one window partition, so groups are cut into stretches of ten timespans;
    each stretch also gets the timespan before it, whose rows count but aren't returned.
    """
    span = seconds(timespan)
    rows = _keyed(events.filter(hit), keys).withColumn("__c", F.floor(F.col("__s") / (10 * span)))
    late = F.floor((F.col("__s") + span) / (10 * span))
    copies = F.array_distinct(F.array(F.col("__c"), late))
    rows = rows.withColumn("__w", F.explode(copies))
    frame = Window.partitionBy(*keys, "__w").orderBy("__s").rangeBetween(-span, 0)
    out = rows.withColumn("match_count", F.count(F.lit(1)).over(frame)).filter((F.col("__w") == F.col("__c")) & (F.col("match_count") >= least))
    return out.drop("__s", "__c", "__w")


def temporal_ordered(events: DataFrame, first: Column, then: Column, keys: list[str], timespan: str) -> DataFrame:
    """Events where `then` holds and an earlier event of the group, at most a timespan before, had `first`.

    Adds first_ts, the latest such time; of events at one time, event_id says which is earlier. Groups are cut into stretches as for event_count.
    """
    span = seconds(timespan)
    rows = _keyed(events.withColumns({"__a": first, "__b": then}).filter("__a or __b"), keys)
    rows = rows.withColumn("__c", F.floor(F.col("__s") / (10 * span)))
    rows = rows.withColumn("__w", F.explode(F.array_distinct(F.array(F.col("__c"), F.floor((F.col("__s") + span) / (10 * span))))))
    order = ["__s", *(["event_id"] if "event_id" in events.columns else [])]
    before = Window.partitionBy(*keys, "__w").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = F.max(F.when(F.col("__a"), F.col("__s"))).over(before)
    out = rows.withColumn("__near", near).filter((F.col("__w") == F.col("__c")) & F.col("__b") & (F.col("__s") - F.col("__near") <= span))
    return out.withColumn("first_ts", F.col("__near")).drop("__a", "__b", "__s", "__c", "__w", "__near")


def run(rule: dict, events: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """A correlation rule over events; hits: the columns of the base rules it names."""
    own = rule.get("correlation")
    if not isinstance(own, dict):
        raise RuleError("not a correlation rule")
    missing = [r for r in own.get("rules", []) if r not in hits]
    if missing:
        raise RuleError(f"no rules {missing}")
    if not own.get("rules") or not own.get("group-by"):
        raise RuleError("a correlation rule needs rules and keys")
    keys = own["group-by"]
    if own.get("type") == "event_count":
        return event_count(events, hits[own["rules"][0]], keys, own["timespan"], int(own["condition"]["gte"]))
    if own.get("type") == "temporal_ordered" and len(own["rules"]) == 2:
        return temporal_ordered(events, hits[own["rules"][0]], hits[own["rules"][1]], keys, own["timespan"])
    raise RuleError(f"correlation type {own.get('type')!r} isn't known")
