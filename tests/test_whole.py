"""Whole triage, stores from files, signed and rotated logs, layers, bundles and text intake."""

import hashlib
import hmac
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberwatch.operators import audit, detection, intake, mapping, policy, retrieval
from emberwatch.plans import pipeline
from emberwatch.sources import stores


def _write(path, name, value):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path / name)


def test_whole_triage_of_odd_events(spark):
    """Structured, malformed and blank lines, group changes, tampering and ARP lines each get all of it."""
    lines = [
        "Failed password for root from 203.0.113.66 port 22 ssh2",
        '{"message": "Accepted password for alice", "src_ip": "198.51.100.77", "user": "alice"}',
        '{"message": "cut',
        "   ",
        None,
        "usermod: add 'eve' to group 'sudo'",
        "bash: history -c run by eve",
        "arp: 192.0.2.1 moved from aa:bb to cc:dd on eth0",
        "x" * 20000,
    ]
    logs = spark.createDataFrame(list(enumerate(lines)), "event_id int, raw string")
    docs = spark.createDataFrame([("a/ssh.md", "Brute force shows as authentication failure. Lock accounts."), ("b/none.md", None)], "source string, text string")
    out = pipeline.process_events(logs, F.lit("2026-08-21").cast("date"), docs)
    rows = {r["event_id"]: r for r in out["events"].collect()}
    assert len(rows) == len(lines)
    assert [(v["needle"], v["risk"]) for v in rows[0]["verdicts"]] == [("203.0.113.66", "malicious")]
    assert [v["risk"] for v in rows[1]["verdicts"]] == ["suspicious"]  # one upstream only
    assert rows[0]["plan"][0]["action_id"] == "capture-volatile-memory" and {a["target"] for a in rows[0]["plan"]} == {"203.0.113.66"}
    assert [r["rule_id"] for r in rows[0]["detections"]] == ["ssh_failed_password"]
    assert rows[3]["question_id"] is None and rows[3]["verdicts"] == [] and rows[4]["verdicts"] == []
    assert [r["rule_id"] for r in rows[5]["detections"]] == ["account_added_to_privileged_group"]
    assert [r["rule_id"] for r in rows[6]["detections"]] == ["linux_command_history_cleared"]
    assert "arp_cache_poisoning" in [r["rule_id"] for r in rows[7]["detections"]]
    cited = out["citations"].filter(F.col("question_id") == rows[0]["question_id"]).collect()
    text = "Brute force shows as authentication failure. Lock accounts."
    assert cited and all(text[c["char_start"] : c["char_end"]] == c["quote"] for c in cited)
    reports = {r["event_id"]: r["report"] for r in pipeline.incident_reports(out, "2026-08-21").collect()}
    assert len(reports) == len(lines) and all(reports[k].count("\n## ") == 17 for k in (0, 1, 2, 5, 6, 7, 8))
    assert "malicious" in reports[0] and "ssh.md" in reports[0].replace("\\", "")


def test_whole_triage_reads_a_line_once(spark):
    """Events of the same line, or of none, have the same said of them, from one reading; other columns keep events apart."""
    lines = ["Failed password for root from 203.0.113.66 port 22 ssh2", None, " ", "useradd: new user: name=u1"] * 50
    logs = spark.createDataFrame(list(enumerate(lines)), "event_id int, raw string")
    docs = spark.createDataFrame([("a.md", "Brute force shows as authentication failure.")], "source string, text string")
    as_of = F.lit("2026-08-21").cast("date")
    out = pipeline.process_events(logs, as_of, docs)
    rows = {r["event_id"]: r.asDict(recursive=True) for r in out["events"].collect()}
    assert sorted(rows) == list(range(200)) and out["lines"].count() == 4
    apart = pipeline.process_events(logs.withColumn("host", F.lit("h")), as_of, docs)["events"].drop("host")
    assert {r["event_id"]: r.asDict(recursive=True) for r in apart.collect()} == rows and rows[0]["verdicts"] and rows[3]["plan"]
    reports = {r["event_id"]: r["report"] for r in pipeline.incident_reports(out, "2026-08-21").collect()}
    assert len(reports) == 200 and all(reports[k] == reports[k % 4] for k in reports)


def test_dossiers_are_made_of_distinct_lines(spark, monkeypatch):
    from emberwatch.plans import queries_whole

    made = []
    monkeypatch.setattr(pipeline, "of_events", lambda seen, rows, own=pipeline.of_events: made.append(rows) or own(seen, rows))
    found = queries_whole.QUERIES["event_dossiers"](spark, "/root/testdata/sf0.001")
    events = found.count()
    assert "detections" in made[-1].columns and "fields" not in made[-1].columns and made[-1].count() < events == made[0].sparkSession.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_plans_and_rules_as_literals_agree_with_the_joins(spark):
    from emberwatch.content.sigma_rules import BASE
    from emberwatch.operators import response

    rows = spark.createDataFrame([(1, ["T1110"], "203.0.113.5"), (2, ["T1136.001", "T1098", "T9999"], None), (3, [], "203.0.113.6"), (4, ["T1046"], "203.0.113.7")], "k int, t array<string>, source string")
    own = rows.select("k", F.explode("t").alias("technique_id"))
    joined = {(r["k"], r["action_id"], r["target"]) for r in response.plans(own, rows.select("k", F.col("source").alias("target")), "k").collect()}
    direct = {(r["k"], r["a"]["action_id"], r["a"]["target"]) for r in rows.select("k", F.explode(response.plan_of(F.col("t"), F.col("source"))).alias("a")).collect()}
    assert joined == direct and joined
    by_join = {(r["k"], r["rule_id"]) for r in detection.for_techniques(own, detection.rule_table(spark, BASE, "base")).collect()}
    by_literal = {(r["k"], r["a"]["rule_id"]) for r in rows.select("k", F.explode(detection.rules_of(F.col("t"), BASE)).alias("a")).collect()}
    assert by_join == by_literal and by_join


def test_rule_files(spark, tmp_path):
    _write(tmp_path, "b.yml", "title: Two\nlevel: high\ntags: [attack.t1110]\ndetection: {s: {'message|contains': x}, condition: s}\n")
    _write(tmp_path, "a.yml", "name: one\ndetection: {s: {'message|contains': y}, condition: s}\n")
    _write(tmp_path, "c.yml", "a: [1, ")
    _write(tmp_path, "d.yml", "- 1\n")
    assert [(r["name"], r["title"], r["level"]) for r in stores.sigma_rules(spark, str(tmp_path))] == [("one", "a", "low"), ("b", "Two", "high")]
    _write(tmp_path, "behaviors.json", {"behaviors": [{"name": "n", "title": "t", "level": "low", "file": "n.yml", "techniques": ["T1", "T2"], "validation": "telemetry-available"}]})
    assert [r["technique_id"] for r in stores.behavior_index(spark, f"{tmp_path}/behaviors.json").collect()] == ["T1", "T2"]


def test_mapping_files(spark, tmp_path):
    def rule(name, **more):
        return {"id": name, "when": [{"field": "event_type", "op": "equals", "values": ["a"]}], "techniques": [{"technique_id": "T1", "tactic": "x", "confidence": "low"}], **more}

    fallback = {"technique_id": "NONE", "tactic": "none", "confidence": "low"}
    _write(tmp_path / "m", "2.json", {"rules": [rule("second")], "fallback": fallback})
    _write(tmp_path / "m", "1.json", {"rules": [rule("first")]})
    rules, own = stores.mapping_rules(spark, str(tmp_path / "m"))
    assert [r["id"] for r in rules] == ["first", "second"] and own == fallback
    rows = mapping.mapped(spark.createDataFrame([("a", "t"), ("b", None)], "event_type string, text string"), rules=rules, fallback=own).collect()
    assert rows[0]["matched_rules"] == ["first", "second"] and rows[1]["primary"]["technique_id"] == "NONE"
    for k, bad in enumerate([{"3.json": {"rules": [], "fallback": fallback}}, {"3.json": "{"}, {"3.json": {"rules": [rule("first")]}}, {"2.json": {"rules": []}}]):
        folder = tmp_path / f"bad{k}"
        for name, value in ({"1.json": {"rules": [rule("first")]}, "2.json": {"rules": [], "fallback": fallback}} | bad).items():
            _write(folder, name, value)
        with pytest.raises(ValueError):
            stores.mapping_rules(spark, str(folder))
    corpus = spark.createDataFrame([("T1", "One", "u", "active", ["x"]), ("T2", "Two", "u", "revoked", ["x"])], "technique_id string, name string, url string, status string, tactics array<string>")
    assert [(r["rule_id"], r["name"]) for r in mapping.check_references(mapping.rule_techniques(spark, rules), corpus).orderBy("rule_id").collect()] == [("first", "One"), ("second", "One")]
    own = spark.createDataFrame([("T1", "y"), ("T2", "x"), ("T3", "x")], "technique_id string, tactic string")
    assert {r["technique_id"]: r["problem"] for r in mapping.resolved(own, corpus).collect()} == {"T1": "tactic", "T2": "revoked", "T3": "unknown"}
    with pytest.raises(ValueError):
        mapping.check_references(own, corpus)


def test_intelligence_files(spark, tmp_path):
    indicator = {"type": "domain", "value": "Bad.example", "risk": "malicious", "confidence": "high", "source_id": "s", "retrieved": "2026-01-01", "expires": "2027-01-01", "reference": "r"}
    behavior = {"id": "b", "attack_techniques": ["T1"], "event_types": ["a"], "confidence": "low", "last_reviewed": "2026-01-01", "review_interval_days": 30, "source_id": "s"}

    def store(name, **change):
        files = {"sources.json": {"sources": [{"source_id": "s", "upstream": "u", "retrieved": "2026-01-01"}]}, "never_flag.json": {"cidrs": ["10.0.0.0/8"]}, "seed/indicators.json": {"indicators": [indicator]}, "behaviors/a.json": {"behaviors": [behavior]}} | change
        for file, value in files.items():
            folder, _, last = file.rpartition("/")
            _write(tmp_path / name / folder, last, value)
        return stores.intel_store(spark, str(tmp_path / name))

    own = store("good")
    assert own["indicators"].first()["value"] == "bad.example" and own["behaviors"].count() == 1 and own["never_flag"] == ["10.0.0.0/8"]
    for k, bad in enumerate([{"seed/indicators.json": {"indicators": [indicator, indicator]}}, {"seed/indicators.json": {"indicators": [indicator | {"source_id": "other"}]}}, {"behaviors/b.json": {"behaviors": [behavior]}}, {"sources.json": {}}]):
        with pytest.raises(ValueError):
            store(f"bad{k}", **bad)


def test_bundles_attestations_pins_locks(spark, tmp_path):
    own = stores.policy_bundle(spark, _write(tmp_path, "p.json", {"policy": {"deployment": "deny", "read_only": "require_approval"}, "allow": ["Ship it"]}))
    rows = spark.createDataFrame([("deployment", "deploy"), ("read_only", "read x"), ("boundary_crossing", "ship it"), ("deployment", "SHIP IT"), ("unknown", "z")], "c string, a string")
    said = [r[0] for r in rows.select(policy.decision(F.col("c"), F.col("a"), own["allow"], own["deny"], own["policy"])).collect()]
    assert said == ["deny", "require_approval", "deny", "allow", "require_approval"]
    for bad in ({"policy": {"nonsense": "deny"}}, {"policy": {"deployment": "maybe"}}, {"allow": "x"}, "[]"):
        with pytest.raises(ValueError):
            stores.policy_bundle(spark, _write(tmp_path, "q.json", bad))
    one = {"control_id": "c", "date": "2026-01-01", "expires": "2026-12-31", "attested_by": "x", "statement": "y"}
    assert stores.attestations(spark, _write(tmp_path, "a.json", {"version": 1, "attestations": [one]})).count() == 1
    for bad in ([one, one], [one | {"expires": "2025-01-01"}], [one | {"more": "z"}], [one | {"date": "soon"}]):
        with pytest.raises(ValueError):
            stores.attestations(spark, _write(tmp_path, "b.json", {"version": 1, "attestations": bad}))
    pin = {"attack_version": "19", "retrieved": "2026-08-21", "bundle": {"file_name": "f.json", "size_bytes": 1, "sha256": "0" * 64}, "shards": {"s.json": "1" * 64}}
    assert stores.pin(spark, _write(tmp_path, "pin.json", pin))["shards"] == pin["shards"]
    for bad in (pin | {"shards": {}}, pin | {"shards": {"../s": "1" * 64}}, pin | {"bundle": {"file_name": "f", "size_bytes": 1, "sha256": "x"}}):
        with pytest.raises(ValueError):
            stores.pin(spark, _write(tmp_path, "pin2.json", bad))
    lock = stores.toml_lock(spark, _write(tmp_path, "uv.lock", '[[package]]\nname = "Foo_Bar"\nversion = "1.0"\n[[package]]\nname = "local"\n'))
    assert [tuple(r) for r in lock.collect()] == [("foo-bar", "1.0")]
    parts = [spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")]
    assert stores.merged(parts, "k").count() == 2
    with pytest.raises(ValueError):
        stores.merged([parts[0], parts[0]], "k")


def test_signed_and_rotated_logs(spark):
    texts = ["", "a|b", "ä" * 100]
    for key in (b"k", b"0" * 64, b"1" * 65):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", audit.hmac(F.col("t"), key).alias("s")).collect()
        assert all(r["s"] == hmac.new(key, r["t"].encode(), hashlib.sha256).hexdigest() for r in rows)
    with pytest.raises(ValueError):
        audit.hmac(F.lit("x"), b"")
    log = audit.append([{"actor": f"a{i}"} for i in range(40)])
    df = spark.createDataFrame([(e["seq"], *[e[f] for f in audit.FIELDS[1:]], e["entry_hash"], 100) for e in log], "seq long, " + ", ".join(f"{f} string" for f in audit.FIELDS[1:]) + ", entry_hash string, size int")
    kept, checkpoint = audit.retained(audit.rotated(df, 1000), 1)
    cut = checkpoint.first()
    assert cut["seq"] == 19 and cut["entry_hash"] == log[19]["entry_hash"] and kept.count() == 20
    assert audit.report(kept, first_seq=cut["seq"] + 1, genesis=cut["entry_hash"]).first()["intact"]
    assert not audit.report(kept, first_seq=cut["seq"] + 1, genesis=audit.GENESIS).first()["intact"]
    kept, checkpoint = audit.retained(audit.rotated(df.filter("seq < 0"), 1000), 0)
    assert kept.count() == 0 and checkpoint.first()["seq"] is None


def test_layer_and_embedding(spark):
    rules = spark.createDataFrame([("r1", "B", "T1"), ("r2", "A", "T1"), ("r2", "A", "T2")], "rule_id string, title string, technique_id string")
    corpus = spark.createDataFrame([("T1", "One", "active"), ("T2", "Two", "active")], "technique_id string, name string, status string")
    layer = json.loads(detection.navigator_layer(rules, corpus, "mine", "19").first()["layer"])
    assert [(t["techniqueID"], t["score"], t["comment"]) for t in layer["techniques"]] == [("T1", 2, "Detected by: A; B - One"), ("T2", 1, "Detected by: A - Two")]
    with pytest.raises(PySparkException):
        detection.navigator_layer(rules, corpus.filter("technique_id = 'T1'"), "mine", "19").collect()
    chunks = spark.createDataFrame([("a", "xx"), ("b", "y")], "source string, text string")
    assert [r["vector"] for r in retrieval.embedded(chunks, lambda ts: [[len(t), 1] for t in ts]).orderBy("source").collect()] == [[2.0, 1.0], [1.0, 1.0]]
    with pytest.raises(PySparkException):
        retrieval.embedded(chunks, lambda ts: []).collect()


def test_intake_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "n", "A subpoena asks for customer personal data. Reply now."), (2, None, ""), (3, "n", None), (4, "My Tool!", "short"), (5, "n", "word " * 5000)], "id int, name string, text string")
    legal = {r["id"]: r for r in intake.legal_assessments(docs).collect()}
    assert set(legal) == {1, 4, 5} and legal[1]["topics"] == ["data protection / privacy", "litigation / dispute"] and len(legal[1]["checklist"]) == 6
    assert legal[1]["escalate"] and legal[4]["topic"] == intake.UNSORTED and not legal[4]["escalate"] and len(legal[5]["inquiry"]) == 200
    offers = {r["id"]: r for r in intake.proposals(docs).collect()}
    assert set(offers) == {1, 4, 5} and offers[4]["areas"] == [intake.UNSCOPED] and offers[4]["objectives"] == ["short"] and len(offers[1]["objectives"]) == 2
    drafts = {r["id"]: r for r in intake.portfolio(docs).collect()}
    assert set(drafts) == {1, 4, 5} and drafts[4]["draft_file"] == "my-tool.md" and "- short" in drafts[4]["draft"]
