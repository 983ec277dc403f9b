"""Incident reports as Markdown, one column expression per section; log text is always escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_safe


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce(markdown_safe(value.cast("string")), F.lit("none")))


def bullets(values: Column) -> Column:
    """An array of texts as a list; none if it is empty."""
    own = F.transform(values, lambda v: F.concat(F.lit("- "), markdown_safe(v)))
    return F.when(F.size(values) > 0, F.array_join(own, "\n")).otherwise("none")


def section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n"), F.coalesce(body, F.lit("none")), F.lit("\n"))


def event_reports(rows: DataFrame, as_of: str) -> DataFrame:
    """rows (as plans.pipeline.process_log returns them) with report: summary, evidence, techniques, indicators,
    rules, plan and actions of each event."""
    head = F.concat_ws("\n", _line("event type", F.col("event_type")), _line("severity", F.col("severity")), _line("score", F.col("severity_score")), _line("source", F.col("source")), _line("input", F.col("parse_status")))
    found = F.transform("evidence", lambda e: F.concat_ws(": ", e["field"], e["value"]))
    mapped = F.transform("techniques", lambda t: F.concat_ws(" ", t["technique_id"], t["tactic"], t["confidence"]))
    parts = [
        F.lit(f"# Incident report\n\nAs of {as_of}.\n"),
        section("Summary", head),
        section("Log", markdown_safe(F.col("text"))),
        section("Evidence", bullets(found)),
        section("Techniques", bullets(mapped)),
        section("Indicators", bullets(F.col("indicators"))),
        section("Rules", bullets(F.col("rules"))),
        section("Actions", bullets(F.col("actions"))),
    ]
    return rows.withColumn("report", F.concat_ws("\n", *parts))


def _either(lines: Column, empty: str) -> Column:
    """Lines of an array joined, or a sentence if there are none (or no array)."""
    return F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, F.array_join(lines, "\n")).otherwise(empty)


def _plan(plan: Column) -> Column:
    """The draft of a plan: what can't be undone and what touches evidence first, then every step with its owner."""
    once = F.array_join(F.transform(F.filter(plan, lambda a: ~a["reversible"]), lambda a: a["action_id"]), ", ")
    evidence = F.array_join(F.transform(F.filter(plan, lambda a: a["destroys_evidence"]), lambda a: a["action_id"]), ", ")
    steps = F.transform(plan, lambda a: F.concat(F.lit("- tier "), a["tier"].cast("string"), F.lit(": "), a["action_id"], F.lit(" on "), markdown_safe(a["target"]), F.lit(", by "), a["owner"]))
    body = F.concat_ws("\n", F.lit("Proposed for a person to decide; nothing was done."), F.concat(F.lit("- can't be undone: "), F.nullif(once, F.lit(""))), F.concat(F.lit("- touches evidence: "), F.nullif(evidence, F.lit(""))), F.array_join(steps, "\n"))
    return F.when(F.size(plan) > 0, body).otherwise("No plan is proposed on this evidence.")


def incident_reports(rows: DataFrame, as_of: str) -> DataFrame:
    """rows (as plans.pipeline.process_events' events, with knowledge and citations) with report.

    Its sections are when it was made, summary, narrative, severity, event type, techniques, evidence, score,
    indicators, actions, sequence, knowledge, cited passages, detections, behaviours, plan and assumptions; one
    without content says so. All that comes from logs or the corpus is escaped.
    """
    techniques = F.transform("techniques", lambda t: F.concat(F.lit("- "), F.concat_ws(" ", t["technique_id"], t["tactic"], t["confidence"])))
    found = F.transform("evidence", lambda e: F.concat(F.lit("- "), e["field"], F.lit(": "), markdown_safe(e["value"]), F.lit(" ("), e["meaning"], F.lit(")")))
    verdict = F.transform("indicators", lambda i: F.concat(F.lit("- "), markdown_safe(i), F.lit(": "), F.coalesce(F.get(F.filter(F.col("verdicts"), lambda v: v["needle"] == F.lower(F.trim(i))), F.lit(0))["risk"], F.lit("unknown"))))
    rules = lambda c: F.transform(c, lambda r: F.concat(F.lit("- "), markdown_safe(r["title"]), F.lit(" ["), r["level"], F.lit("] "), markdown_safe(r["rule_id"])))
    known = F.transform("knowledge", lambda r: F.concat(F.lit("- "), markdown_safe(r["source"]), F.lit(" ("), F.format_number(r["score"], 2), F.lit("): "), markdown_safe(r["snippet"])))
    cited = F.transform("citations", lambda c: F.concat(c["rank"].cast("string"), F.lit(". "), markdown_safe(c["source"]), F.lit(" ("), c["char_start"].cast("string"), F.lit("-"), c["char_end"].cast("string"), F.lit(', '), F.format_number(c["score"], 2), F.lit('): "'), markdown_safe(c["quote"]), F.lit('"')))
    told = F.concat(F.lit("An event of type "), F.col("event_type"), F.lit(" and severity "), F.col("severity"), F.lit(" was read"), F.coalesce(F.concat(F.lit(" from "), markdown_safe(F.col("source"))), F.lit("")), F.lit("."))
    parts = [
        F.lit("# Incident report\n"),
        section("Generated", F.lit(as_of)),
        section("Summary", markdown_safe(F.col("text"))),
        section("Narrative", told),
        section("Severity", F.col("severity")),
        section("Event type", F.col("event_type")),
        section("Techniques", _either(techniques, "No technique is attributed.")),
        section("Evidence", _either(found, "No structured evidence.")),
        section("Severity score", F.concat(F.col("severity_score").cast("string"), F.lit(" / 100"))),
        section("Indicators", _either(verdict, "None found.")),
        section("Actions", bullets(F.col("actions"))),
        section("Sequence", F.lit("A single event, without a sequence.")),
        section("Knowledge", _either(known, "None found.")),
        section("Cited passages (verified)", _either(cited, "None found.")),
        section("Detections", _either(rules(F.col("detections")), "No rule covers these techniques.")),
        section("Behaviours", _either(rules(F.col("behaviors")), "No behavioural rule covers these techniques.")),
        section("Response plan (draft)", _plan(F.col("plan"))),
        section("Assumptions", F.lit("- Only this event's text was read.\n- Types and severities follow fixed rules and may be wrong.")),
    ]
    return rows.withColumn("report", F.concat_ws("\n", *parts))


def sequence_reports(rolled: DataFrame, findings: DataFrame) -> DataFrame:
    """One report per sequence: its roll-up and the findings, highest block and source first."""
    said = F.concat_ws(" ", F.col("pattern"), F.lit("from"), F.col("source"), F.lit("severity"), F.col("severity"), F.concat(F.lit("events "), F.col("event_count").cast("string")))
    lines = findings.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("block", "source", said.alias("said")))).alias("f"))
    own = rolled.join(lines, "sequence_id", "left")
    head = F.concat_ws("\n", _line("events", F.col("event_count")), _line("severity", F.col("severity")), _line("score", F.col("severity_score")), _line("without source", F.col("uncorrelated_count")))
    body = bullets(F.coalesce(F.transform("f", lambda x: x["said"]), F.array().cast("array<string>")))
    return own.withColumn("report", F.concat_ws("\n", F.lit("# Sequence report\n"), section("Summary", head), section("Findings", body))).drop("f")
