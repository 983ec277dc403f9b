"""Entity risk: weighted scores within a trailing window, findings over a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept

THRESHOLD, WINDOW_SECONDS, DEFAULT_WEIGHT = 90.0, 3600.0, 1.0
#: Weight of each event type. Fixed values.
WEIGHTS = {
    "log tampering": 1.5,
    "privileged group addition": 1.4,
    "arp spoofing": 1.3,
    "successful login": 1.2,
    "authentication failure": 1.0,
    "account creation": 1.0,
    "port scan": 0.8,
    "ids alert": 0.7,
    "firewall block": 0.6,
    "network anomaly": 0.5,
    "unknown security event": 0.5,
}


def weight(kind: Column, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT) -> Column:
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)])
    return F.coalesce(F.element_at(table, kind), F.lit(default))


def contributions(events: DataFrame) -> DataFrame:
    """entity (source, else first indicator, else unknown), event_type, score, timestamp, idx of triaged events."""
    entity = F.coalesce("source", F.get("indicators", F.lit(0)), F.lit("unknown"))
    stamp = F.col("timestamp").cast("double") if "timestamp" in events.columns else F.lit(None).cast("double")
    return events.select(entity.alias("entity"), "event_type", F.col("severity_score").cast("double").alias("score"), stamp.alias("timestamp"), "idx")


def windowed(rows: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Rows within the window that ends at their entity's newest timestamp (inclusive), and rows without one.

    The newest timestamp is aggregated apart and joined, so an entity with very many rows isn't one task's.
    """
    newest = rows.groupBy(F.col("entity").alias("__e")).agg(F.max("timestamp").alias("__newest"))
    near = rows.join(newest, rows["entity"] == newest["__e"])
    keep = F.col("timestamp").isNull() | (F.col("__newest") - F.col("timestamp") <= window_seconds)
    return near.filter(keep).drop("__e", "__newest")


def findings(rows: DataFrame, *, threshold: float = THRESHOLD, window_seconds: float | None = WINDOW_SECONDS, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT) -> DataFrame:
    """entity, total, dominant_type, n_events, distinct_types of entities whose weighted total reaches the threshold.

    Sums are decimal, so they don't depend on order. The dominant type has the largest sum; ties go to the name
    that sorts first. Findings compare the unrounded total.
    """
    near = rows if window_seconds is None else windowed(rows, window_seconds)
    value = (F.col("score") * weight(F.col("event_type"), weights, default)).cast("decimal(18,4)")
    per_type = near.groupBy("entity", "event_type").agg(F.sum(value).alias("part"), F.count(F.lit(1)).alias("n"))
    out = per_type.groupBy("entity").agg(
        F.sum("part").alias("total"),
        F.min(F.struct((-F.col("part")).alias("neg"), "event_type")).alias("top"),
        F.sum("n").alias("n_events"),
        F.count(F.lit(1)).alias("distinct_types"),
    )
    return out.filter(F.col("total") >= F.lit(threshold).cast("decimal(18,4)")).select("entity", F.col("total").cast("double"), F.col("top.event_type").alias("dominant_type"), "n_events", "distinct_types")


def running_totals(rows: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """rows with the entity's weighted total over the trailing window that ends at each row.

    Values are summed by entity and second first; what a second adds it takes away once the window has passed, so that one
    running sum gives all totals, however many rows a window holds. A hot entity (such as the unknown one) would be one
    window partition, so entities are cut into stretches of ten windows; each stretch begins with what the window before it
    leaves, and holds twice its seconds of sums at most. Rows without a timestamp have the total of the entity's others without one.
    """
    span = int(window_seconds)
    value = (F.col("score") * weight(F.col("event_type"))).cast("decimal(18,4)")
    second = F.floor("timestamp").cast("long")
    rows = kept(rows.withColumn("__t", second))  # read for the sums and for the result
    sums = rows.groupBy(F.col("entity").alias("__e"), F.col("__t").alias("__s")).agg(F.sum(value).alias("v"), F.count(value).alias("n"))
    timed, stretch = sums.filter("__s is not null"), lambda at: F.floor(at / (10 * span))
    zero = F.lit(0).cast("decimal(28,4)")
    v = F.coalesce("v", zero)
    # a second's own stretch and, if the window reaches over it, the next
    spread = timed.withColumns({"v": v, "__w": F.explode(F.array_distinct(F.array(stretch(F.col("__s")), stretch(F.col("__s") + span))))})
    begins, ends = F.col("__w") * (10 * span), F.col("__s") + span + 1
    added = F.struct(F.greatest("__s", begins).alias("at"), F.col("v").alias("v"), F.col("n").alias("n"), (F.col("__s") >= begins).alias("own"))
    taken = F.when(ends < begins + 10 * span, F.struct(ends.alias("at"), (-F.col("v")).cast("decimal(28,4)").alias("v"), (-F.col("n")).alias("n"), F.lit(False).alias("own")))
    steps = spread.select("__e", "__w", F.explode(F.array_compact(F.array(added, taken))).alias("x")).select("__e", "__w", "x.*")
    steps = steps.groupBy("__e", "__w", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.bool_or("own").alias("own"))
    upto = Window.partitionBy("__e", "__w").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = steps.withColumns({"v": F.sum("v").over(upto), "n": F.sum("n").over(upto)}).filter("own")
    totals = totals.select("__e", F.col("at").alias("__s"), F.when(F.col("n") > 0, F.col("v").cast("double")).alias("running_total"))
    untimed = sums.filter("__s is null").select("__e", "__s", F.col("v").cast("double").alias("running_total"))
    return rows.join(totals.unionByName(untimed), F.col("entity").eqNullSafe(F.col("__e")) & F.col("__t").eqNullSafe(F.col("__s")), "left").drop("__e", "__s", "__t")


def validated(rows: DataFrame) -> DataFrame:
    """rows; raises where an entity is blank or a score negative or missing."""
    bad = (F.trim(F.coalesce("entity", F.lit(""))) == "") | F.col("score").isNull() | (F.col("score") < 0)
    return rows.withColumn("score", F.when(bad, F.raise_error(F.lit("a contribution has no entity or a bad score")).cast("double")).otherwise(F.col("score")))
