"""Correlation of event sequences: brute force, failure then success, ARP bursts, and roll-ups.

Rows are triaged events with sequence_id and idx (order of arrival, which doesn't repeat within a sequence). summary() and evidence() take sources of
any size: counts and least indices are aggregated before they are moved, and evidence stays rows. findings() puts the
evidence of a finding into its row, so that a source's evidence meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .soc import base_score

FAILURES, ARP_EVENTS = 3, 3
_FAIL, _LOGIN, _ARP = "authentication failure", "successful login", "arp spoofing"


KEYS = ["sequence_id", "source"]
#: Range of idx within which one task numbers the evidence of a finding.
STRETCH = 1 << 16


def _correlated(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.filter(F.col("source").isNotNull() & kind.isin(_FAIL, _LOGIN, _ARP)).select(*KEYS, "idx", kind.alias("kind"), "privileged")


def summary(events: DataFrame, failures: int = FAILURES, arp_events: int = ARP_EVENTS) -> DataFrame:
    """sequence_id, source, pattern, severity, event_count, first_idx, last_idx (of the evidence), block (sort key).

    events are read three times, so they had better be a table than a plan.
    """
    own, idx = _correlated(events), F.col("idx")
    fail, arp = F.col("kind") == _FAIL, F.col("kind") == _ARP
    groups = own.groupBy(*KEYS).agg(
        F.count_if(fail).alias("n_fail"), F.min(F.when(fail, idx)).alias("first_fail"), F.max(F.when(fail, idx)).alias("last_fail"),
        F.count_if(arp).alias("n_arp"), F.min(F.when(arp, idx)).alias("first_arp"), F.max(F.when(arp, idx)).alias("last_arp"),
        F.bool_or(fail & F.col("privileged")).alias("privileged"),
    )
    # the first login after the first failure, then the failures before it
    failed = groups.filter("first_fail is not null").select(*KEYS, "first_fail")
    logins = own.filter(F.col("kind") == _LOGIN).join(failed, KEYS).filter("idx > first_fail").groupBy(*KEYS).agg(F.min("idx").alias("login"))
    before = own.filter(fail).join(logins, KEYS).filter("idx < login").groupBy(*KEYS).agg(F.first("login").alias("login"), F.count(F.lit(1)).alias("n_before"))
    all_groups = groups.join(before, KEYS, "left")

    def found(when, pattern: str, level, n, first: str, last: str, block: int):
        return F.when(when, F.struct(F.lit(pattern).alias("pattern"), level.alias("severity"), n.cast("long").alias("event_count"), F.col(first).alias("first_idx"), F.col(last).alias("last_idx"), F.lit(block).alias("block")))

    each = F.array_compact(
        F.array(
            found(F.col("n_fail") >= failures, "brute_force", F.when(F.col("privileged"), "critical").otherwise("high"), F.col("n_fail"), "first_fail", "last_fail", 0),
            found(F.col("login").isNotNull(), "auth_failure_then_success", F.lit("critical"), F.col("n_before") + 1, "first_fail", "login", 0),
            found(F.col("n_arp") >= arp_events, "arp_spoof_burst", F.lit("critical"), F.col("n_arp"), "first_arp", "last_arp", 1),
        )
    )
    return all_groups.select(*KEYS, F.explode(each).alias("f")).select(*KEYS, "f.*")


def evidence(events: DataFrame, found: DataFrame) -> DataFrame:
    """sequence_id, source, pattern, place (from 0, by idx), idx: a row per event that a finding of summary() rests on.

    Places are counted within stretches of idx, and stretches by their counts: no task orders the evidence of a source.
    """
    kind, pattern, idx = F.col("kind"), F.col("pattern"), F.col("idx")
    chain = (pattern == "auth_failure_then_success") & (((kind == _FAIL) & (idx < F.col("last_idx"))) | ((kind == _LOGIN) & (idx == F.col("last_idx"))))
    rests = chain | ((pattern == "brute_force") & (kind == _FAIL)) | ((pattern == "arp_spoof_burst") & (kind == _ARP))
    key = [*KEYS, "pattern"]
    rows = _correlated(events).join(found.select(*key, "last_idx"), KEYS).filter(rests)
    rows = kept(rows.select(*key, "idx", F.floor(idx / STRETCH).alias("stretch")))
    order = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key, "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*key, "stretch").orderBy("idx"))
    return rows.withColumn("within", within).join(counts.drop("n"), [*key, "stretch"]).select(*key, (F.col("before") + F.col("within") - 1).alias("place"), "idx")


def findings(events: DataFrame, failures: int = FAILURES, arp_events: int = ARP_EVENTS) -> DataFrame:
    """sequence_id, source, pattern, severity, event_count, evidence (indices, ascending), block (sort key)."""
    kind, idx = F.col("event_type"), F.col("idx")
    own = events.filter(F.col("source").isNotNull() & kind.isin(_FAIL, _LOGIN, _ARP))

    earlier = Window.partitionBy("sequence_id", "source").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("failed", F.max(kind == _FAIL).over(earlier))  # rows of a group are together anyway, for its evidence

    def indices(what: str):
        return F.array_sort(F.collect_list(F.when(kind == what, idx)))

    groups = own.groupBy("sequence_id", "source").agg(
        F.count_if(kind == _FAIL).alias("n_fail"),
        F.count_if(kind == _ARP).alias("n_arp"),
        F.bool_or((kind == _FAIL) & F.col("privileged")).alias("privileged"),
        F.min(F.when((kind == _LOGIN) & F.col("failed"), idx)).alias("login"),
        indices(_FAIL).alias("fails"),
        indices(_ARP).alias("arps"),
    )
    login = F.col("login")
    before = F.filter("fails", lambda i: i < login)

    def found(when, pattern: str, level, evidence, block: int):
        return F.when(when, F.struct(F.lit(pattern).alias("pattern"), level.alias("severity"), F.size(evidence).cast("long").alias("event_count"), evidence.alias("evidence"), F.lit(block).alias("block")))

    all_found = F.array_compact(
        F.array(
            found(F.col("n_fail") >= failures, "brute_force", F.when(F.col("privileged"), "critical").otherwise("high"), F.col("fails"), 0),
            found(login.isNotNull(), "auth_failure_then_success", F.lit("critical"), F.concat(before, F.array(login)), 0),
            found(F.col("n_arp") >= arp_events, "arp_spoof_burst", F.lit("critical"), F.col("arps"), 1),
        )
    )
    return groups.select("sequence_id", "source", F.explode(all_found).alias("f")).select("sequence_id", "source", "f.*")


def roll_up(events: DataFrame, found: DataFrame) -> DataFrame:
    """One row per sequence: counts, top event, top finding, overall severity and score.

    The top event is the first with the highest severity and score; the overall score with findings is the larger
    of the top finding's base plus ten (100 at most) and the top event's; ties of severity go to the finding.
    """
    rank = base_score(F.col("severity"))
    top = F.max(F.struct(rank.alias("rank"), F.col("severity_score").alias("score"), (-F.col("idx")).alias("neg"), "severity", "event_type")).alias("top")
    anchor = F.max(F.struct(F.col("severity_score").alias("score"), (-F.col("idx")).alias("neg"))).alias("anchor")
    per = events.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("source").isNull()).alias("uncorrelated_count"),
        F.count_if(F.col("parse_status") == "malformed_json").alias("malformed_count"),
        top,
        anchor,
    )
    order = F.struct(rank.alias("rank"), (-F.col("block")).alias("b"))
    best = found.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("finding_count"), F.max_by("severity", order).alias("finding_severity"), F.max(rank).alias("finding_rank"))
    out = per.join(best, "sequence_id", "left")
    has = F.col("finding_rank").isNotNull()
    overall = F.when(has & (F.col("finding_rank") >= F.col("top.rank")), F.col("finding_severity")).otherwise(F.col("top.severity"))
    score = F.when(has, F.greatest(F.least(F.col("finding_rank") + 10, F.lit(100)), F.col("top.score"))).otherwise(F.col("top.score"))
    return out.select(
        "sequence_id",
        "event_count",
        "uncorrelated_count",
        "malformed_count",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.col("top.event_type").alias("top_event_type"),
        (-F.col("top.neg")).alias("top_idx"),
        (-F.col("anchor.neg")).alias("anchor_idx"),
        overall.alias("severity"),
        score.cast("int").alias("severity_score"),
    )
