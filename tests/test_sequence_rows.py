"""Findings of sources of any size, and their evidence as rows, against findings in one row and plain loops."""

import random

from pyspark.sql import functions as F

from emberwatch.operators import sequence

KINDS = ["authentication failure", "successful login", "arp spoofing", "port scan"]


def test_rows_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(sequence, "STRETCH", 7)
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c"]), i, rng.choice([*"wxyz", None]), rng.choices(KINDS, [3, rng.choice([0, 1]), 2, 4])[0], rng.random() < 0.1) for i in range(600)]
    rows += [("late", 10_000, "w", KINDS[1], False), ("late", 10_001, "w", KINDS[0], False), ("late", 10_002, "w", KINDS[1], True)]
    events = spark.createDataFrame(rows, "sequence_id string, idx long, source string, event_type string, privileged boolean")
    expected = {(r["sequence_id"], r["source"], r["pattern"]): r for r in sequence.findings(events).collect()}
    found = sequence.summary(events)
    got = {(r["sequence_id"], r["source"], r["pattern"]): r for r in found.collect()}
    assert got.keys() == expected.keys() and ("late", "w", "auth_failure_then_success") in got
    for key, r in got.items():
        e = expected[key]
        assert (r["severity"], r["event_count"], r["first_idx"], r["last_idx"], r["block"]) == (e["severity"], e["event_count"], e["evidence"][0], e["evidence"][-1], e["block"])
    evidence = {}
    for r in sequence.evidence(events, found).orderBy("place").collect():
        assert r["place"] == len(evidence.setdefault((r["sequence_id"], r["source"], r["pattern"]), []))
        evidence[r["sequence_id"], r["source"], r["pattern"]].append(r["idx"])
    assert evidence == {key: e["evidence"] for key, e in expected.items()}


def test_one_source_with_all_failures(spark):
    n = 300_000
    events = spark.range(n).select(F.lit("s").alias("sequence_id"), F.col("id").alias("idx"), F.lit("203.0.113.1").alias("source"), F.when(F.col("id") == n - 2, KINDS[1]).otherwise(KINDS[0]).alias("event_type"), F.lit(False).alias("privileged"))
    found = sequence.summary(events)
    assert {(r["pattern"], r["event_count"], r["first_idx"], r["last_idx"]) for r in found.collect()} == {("brute_force", n - 1, 0, n - 1), ("auth_failure_then_success", n - 1, 0, n - 2)}
    rows = sequence.evidence(events, found)
    assert tuple(rows.agg(F.count(F.lit(1)), F.max("place"), F.count_if(F.col("place") == F.col("idx"))).first()) == (2 * n - 2, n - 2, 2 * n - 3)


def test_no_events(spark):
    events = spark.createDataFrame([], "sequence_id string, idx long, source string, event_type string, privileged boolean")
    found = sequence.summary(events)
    assert found.count() == 0 and sequence.evidence(events, found).count() == 0
