"""End-to-end plans: raw logs to triaged, mapped, enriched events; sequences to incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..content.sigma_rules import BASE, BEHAVIOR
from ..functions.lineage import kept
from ..operators import detection, intel, mapping, ocsf, report, response, retrieval, risk, sequence, sigma, soc
from ..sources import vendors


def process_log(logs: DataFrame, raw: str = "raw") -> DataFrame:
    """logs with everything a single event gets, in one projection without a shuffle: triage, evidence, actions,
    techniques, matching rules, OCSF class. Rejected (blank) rows keep their status."""
    df = soc.triaged(soc.normalised_input(logs, raw))
    df = df.withColumns({"evidence": soc.evidence(F.col("text"), F.col("fields"), F.col("event_type")), "actions": soc.recommended_actions(F.col("event_type"), F.col("severity")), "ocsf": ocsf.of_type(F.col("event_type"))})
    # mapping looks at the raw text, rules at the message
    df = mapping.mapped(df.withColumns({"__raw": F.col(raw), "message": F.col("text")}), "event_type", "__raw")
    return sigma.matches(df, BASE + BEHAVIOR).drop("__raw", "message")


def indicator_verdicts(events: DataFrame, as_of) -> DataFrame:
    """Verdicts of every distinct indicator of triaged events."""
    spark = events.sparkSession
    values = events.select(F.explode("indicators").alias("value")).distinct()
    known = intel.checked(intel.atomic(spark), ["type", "value", "source_id"], intel.MOST_ATOMIC, intel.sources(spark))
    out = intel.verdicts(values, known, intel.sources(spark), as_of)
    return out.withColumn("kind", intel.indicator_kind(F.col("needle")))


def questions(events: DataFrame) -> DataFrame:
    """question_id, query: what is asked of the corpus about events, a row per event type and first technique.

    There are at most as many as event types times mapping rules, however many events there are.
    """
    primary = F.get("techniques", F.lit(0))
    own = events.select("event_type", F.coalesce(primary["technique_id"], F.lit("")).alias("t"), F.coalesce(primary["tactic"], F.lit("")).alias("tactic")).distinct()
    name = F.coalesce(mapping.technique_name(F.col("t")), F.lit(""))
    return own.select(F.concat_ws("/", "event_type", "t").alias("question_id"), F.concat_ws(" ", "event_type", F.replace("tactic", F.lit("-"), F.lit(" ")), name).alias("query"))


def process_events(logs: DataFrame, as_of, docs: DataFrame, *, key: str = "event_id", raw: str = "raw", k: int = 3) -> dict[str, DataFrame]:
    """All that is said about each event of logs (key, raw), given a corpus (docs: source, text).

    events: process_log's columns with detections, behaviors and plan (arrays), question_id, and verdicts (array of (needle,
    risk, confidence), in order of needle; empty without indicators). knowledge and citations: the k best sources and the
    verified quotes of each question_id. Blank rows get no verdict and no question. All of it follows from the line alone, so
    distinct lines are read once and kept: lines has events' columns by line, seen the line of each event (see of_events).
    Where logs has other columns, which rules may look at, each event is a line of its own.
    """
    alone = {c.lower() for c in logs.columns} == {key.lower(), raw.lower()}
    read = process_log(logs.select(raw).distinct() if alone else logs, raw).withColumn("line", F.col(raw if alone else key))
    found = F.col("techniques.technique_id")
    read = read.withColumns({"detections": detection.rules_of(found, BASE), "behaviors": detection.rules_of(found, BEHAVIOR), "plan": response.plan_of(found, F.col("source"))})
    question = F.when(F.col("parse_status") != "rejected", F.concat_ws("/", "event_type", F.coalesce(F.get(found, F.lit(0)), F.lit(""))))
    lines = kept(read.withColumns({"question_id": question, "__n": F.monotonically_increasing_id()}))
    live = lines.filter("parse_status <> 'rejected'")
    asked = kept(questions(live))
    own_chunks = retrieval.chunks(docs)
    each = live.select("__n", F.explode("indicators").alias("indicator")).withColumn("needle", F.lower(F.trim("indicator")))
    said = each.join(indicator_verdicts(live, as_of), "needle").groupBy("__n").agg(F.array_sort(F.collect_set(F.struct("needle", "risk", "confidence"))).alias("verdicts"))
    none = F.array().cast("array<struct<needle: string, risk: string, confidence: string>>")
    lines = lines.join(said, "__n", "left").drop("__n").withColumn("verdicts", F.coalesce("verdicts", none))
    seen = logs.select(key, F.col(raw if alone else key).alias("line"))
    queries = asked.select(F.col("question_id").alias("query_id"), "query")
    cited = retrieval.verified(retrieval.citations(own_chunks, queries, k=k), docs)
    # citations of a question stand only if all of them do
    false = cited.filter(~F.col("valid")).select("query_id").distinct()
    return {
        "events": of_events(seen, lines) if alone else lines.drop("line"),
        "lines": lines,
        "seen": seen,
        "knowledge": retrieval.retrieve(own_chunks, queries, k).withColumnRenamed("query_id", "question_id"),
        "citations": cited.join(false, "query_id", "left_anti").withColumnRenamed("query_id", "question_id").drop("valid"),
    }


def of_events(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of rows (a row per line) for each event of seen (key, line); a null line is one, too."""
    return seen.join(rows.withColumnRenamed("line", "__line"), F.col("line").eqNullSafe(F.col("__line"))).drop("line", "__line")


def line_reports(tables: dict[str, DataFrame], as_of: str) -> DataFrame:
    """line, report of each line of process_events: knowledge and citations are gathered by question first, a few each."""
    known = tables["knowledge"].groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "score", "snippet"))).alias("knowledge"))
    cited = tables["citations"].groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "char_start", "char_end", "score", "quote"))).alias("citations"))
    # a row for each question, of which there are few
    rows = tables["lines"].join(F.broadcast(known), "question_id", "left").join(F.broadcast(cited), "question_id", "left")
    return report.incident_reports(rows, as_of).select("line", "report")


def incident_reports(tables: dict[str, DataFrame], as_of: str) -> DataFrame:
    """key, report of each event of process_events."""
    return of_events(tables["seen"], line_reports(tables, as_of))


def process_sequence(logs: DataFrame, as_of, raw: str = "raw") -> dict[str, DataFrame]:
    """Tables of sequences (logs: sequence_id, idx, raw): events, findings, sequences, anchors, rules, verdicts,
    risk, sources, reports. Blank rows are counted apart as rejected, not fatal to their sequence."""
    spark = logs.sparkSession
    every = process_log(logs, raw)
    rejected = every.filter("parse_status = 'rejected'").groupBy("sequence_id").agg(F.count(F.lit(1)).alias("rejected"))
    events = every.filter("parse_status <> 'rejected'")
    findings = sequence.findings(events)
    rolled = sequence.roll_up(events, findings).join(rejected, "sequence_id", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))
    anchors = events.join(rolled.select("sequence_id", F.col("anchor_idx").alias("idx")), ["sequence_id", "idx"])
    from ..content.sigma_rules import CORRELATION

    rules = detection.ranked(detection.for_findings(findings, detection.rule_table(spark, CORRELATION, "correlation")), "sequence_id")
    # the sequence path gives no timestamps to the risk engine, so its window never filters
    contributions = risk.contributions(events.drop("timestamp"))
    return {
        "events": events,
        "findings": findings,
        "sequences": rolled,
        "anchors": anchors,
        "rules": rules,
        "verdicts": indicator_verdicts(events, as_of),
        "risk": risk.findings(contributions),
        "sources": ocsf.labelled_sources(events),
        "reports": report.sequence_reports(rolled, findings),
    }


def normalised_matches(records: DataFrame, *keep: str, raw: str = "raw") -> DataFrame:
    """Vendor records to rule hits: parsed, flattened, matched, classed."""
    parsed = vendors.normalised(records, raw)
    view = vendors.match_view(parsed, *keep)
    out = sigma.matches(view, BASE + BEHAVIOR)
    return out.withColumn("ocsf", ocsf.of_activity(F.col("source_type"), F.col("activity")))


def response_plans(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Plans for the techniques of events, with their sources as targets."""
    # the outer form keeps the optimizer from repeating the mapping in a filter below the explosion
    techniques = events.select(key, F.explode_outer("techniques.technique_id").alias("technique_id")).filter("technique_id is not null")
    targets = events.select(key, F.col("source").alias("target"))
    return response.plans(techniques, targets, key)
