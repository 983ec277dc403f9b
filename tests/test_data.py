import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberwatch.operators import audit, compliance, graph, intake, inventory, retrieval, vulnerability
from emberwatch.sources import readers, sinks, vendors

T = "2026-08-14T09:31:44Z"
RECORDS = {
    "sysmon": {"Provider": "Microsoft-Windows-Sysmon", "EventID": 1, "EventData": {"UtcTime": T, "Image": "cmd.exe", "ParentImage": "winword.exe", "CommandLine": "cmd /c x", "Hashes": "SHA256=" + "ab" * 32}},
    "auditd": {"type": "EXECVE", "msg": "audit(1755162662.451:12)", "a0": "sh", "a10": "z", "a2": "b", "exe": "/bin/sh"},
    "zeek": {"id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2", "id.orig_p": 5, "id.resp_p": 53, "ts": 1755162700.12, "_path": "dns", "query": "q.example"},
    "suricata": {"event_type": "ALERT", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "timestamp": T, "alert": {"signature": "S", "signature_id": 7}},
    "aws-cloudtrail": {"eventSource": "s3.amazonaws.com", "eventName": "Get", "eventTime": T, "userIdentity": {"userName": "u", "arn": "arn:x"}, "errorCode": "Denied"},
    "azure-activity": {"operationName": {"value": "op"}, "resourceId": "r", "time": T},
    "entra-id": {"userPrincipalName": "u@x.example", "appDisplayName": "A", "createdDateTime": T, "status": {"errorCode": 50126}},
    "okta": {"eventType": "user.session.start", "actor": {"id": "1"}, "outcome": {"result": "OK"}, "published": T},
    "defender-o365": {"NetworkMessageId": "n", "SenderFromAddress": "a@b.example", "RecipientEmailAddress": [f"r{i}@x.example" for i in range(40)], "Timestamp": T},
    "google-workspace": {"message_id": "m", "sender_address": "a@b.example", "event_timestamp": T, "status": "SENT", "urls": ["http://u.example/1"]},
}


def test_vendors(spark):
    rows = [(k, json.dumps(v)) for k, v in RECORDS.items()]
    rows += [("both", json.dumps(RECORDS["okta"] | RECORDS["zeek"])), ("bad", "{x"), ("array", "[1]"), ("deep", '{"a":' * 40 + "1" + "}" * 40), ("large", "x" * 262_145), ("null", None), ("odd", '{"EventID": {"a": 1}, "type": [1], "eventSource": 5}')]
    got = {r["name"]: r for r in vendors.normalised(spark.createDataFrame(rows, "name string, raw string")).collect()}
    for k in RECORDS:
        assert got[k]["event"]["vendor"] == k, k
    event = {k: got[k]["event"] for k in got}
    assert event["auditd"]["timestamp"] == 1755162662.451 and event["auditd"]["actor"]["command_line"] == "sh b z"
    assert event["zeek"]["src_endpoint"]["port"] == "5" and event["zeek"]["message"] == "zeek dns 10.0.0.1:5 -> 10.0.0.2:53 query=q.example"
    assert event["suricata"]["activity"] == "alert" and event["suricata"]["vendor_event_id"] == "7"
    assert event["aws-cloudtrail"]["message"].endswith("error=Denied") and event["entra-id"]["message"].endswith("outcome=failure (50126)")
    assert "ab" * 32 in event["sysmon"]["observables"] and len(event["defender-o365"]["email"]["recipients"]) == 32
    assert event["defender-o365"]["parse_status"] == "partial" and event["google-workspace"]["parse_status"] == "structured"
    for k in ("both", "bad", "array", "deep", "large", "null", "odd"):
        assert event[k]["vendor"] == "unrecognized", k
    assert event["deep"]["notes"] == ["too deep"] and event["large"]["notes"] == ["too large"]
    view = vendors.match_view(vendors.normalised(spark.createDataFrame(rows[:1], "name string, raw string")), "name").first()
    assert view["image"] == "cmd.exe" and view["parent_image"] == "winword.exe" and view["user"] is None


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "alpha beta. gamma delta rare! alpha beta"), ("b", "alpha beta"), ("c", ""), ("d", None)], "source string, text string")
    queries = spark.createDataFrame([(1, "the rare alpha"), (2, "nothing here")], "query_id int, query string")
    chunks = retrieval.chunks(docs)
    got = retrieval.retrieve(chunks, queries).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["source"]) for r in got] == [(1, "a"), (1, "b")] and got[0]["score"] == 1.0
    cited = retrieval.citations(chunks, queries)
    best = cited.orderBy("rank").first()
    assert best["quote"] == "gamma delta rare!"
    assert all(r["valid"] for r in retrieval.verified(cited, docs).collect())
    forged = cited.withColumn("char_start", F.col("char_start") + 1).withColumn("char_end", F.col("char_end") + 1)
    assert not any(r["valid"] for r in retrieval.verified(forged, docs).collect())


def test_audit(spark):
    rows = audit.append([{"timestamp": str(i), "actor": "a|b", "action": "x", "action_class": "read_only", "decision": "allow", "reason": ""} for i in range(20)])
    whole = audit.report(spark.createDataFrame(rows)).first()
    assert whole["intact"] and whole["head_hash"] == rows[-1]["entry_hash"]
    for change, problem, at in ((lambda r: r[5].update(actor="c"), "hash mismatch", 5), (lambda r: r.pop(5), "gap", 6), (lambda r: r.append(dict(r[5])), "repeated seq", 5), (lambda r: r[5].update(audit.append([r[5]], seq=5, prev_hash="1" * 64)[0]), "chain break", 5)):
        own = [dict(r) for r in rows]
        change(own)
        got = audit.report(spark.createDataFrame(own)).first()
        assert not got["intact"] and (got["problem"], got["first_bad_seq"]) == (problem, at)
    late = audit.report(spark.createDataFrame(rows[7:]), first_seq=7, genesis=rows[6]["entry_hash"]).first()
    assert late["intact"]


def test_audit_segments(spark, tmp_path):
    rows = audit.append([{"timestamp": str(i)} for i in range(9)])
    for name, part in (("log.2", rows[:3]), ("log.1", rows[3:6]), ("log", rows[6:])):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in part))
    lines = audit.parsed(audit.segments(spark, str(tmp_path)))
    assert [r["seq"] for r in lines.orderBy("file_order", "line").collect()] == list(range(9))
    assert audit.report(lines.filter("not malformed")).first()["intact"]
    queue = spark.createDataFrame([(1, "submitted", "a", "p1"), (2, "submitted", "a", "p2"), (3, "submitted", "b", "q"), (4, "resolved", "b", ""), (5, "consumed", "b", "")], "line long, kind string, ref string, payload string")
    assert [(r["ref"], r["payload"]) for r in audit.pending(queue).collect()] == [("a", "p2")]
    assert tuple(audit.queue_counts(queue).first()) == (5, 1, 1, 1)


def test_compliance(spark, tmp_path):
    rows = [("a", "pass", "x", ["F", "F", "G"]), ("b", "fail", "x", ["F"]), ("c", "attested", "y", ["G"]), ("d", "manual", "y", [])]
    df = spark.createDataFrame(rows, "control_id string, status string, category string, frameworks array<string>")
    assert tuple(compliance.score(df).first()) == (1, 2, 50)
    assert {r["framework"]: (r["passing"], r["total"]) for r in compliance.by_framework(df).collect()} == {"F": (1, 2), "G": (2, 2)}
    assert compliance.score(df.filter("false")).first()["percent"] == 0
    assert {r["status"]: r["n"] for r in compliance.tally(df).collect()}["error"] == 0
    assert [r["control_id"] for r in compliance.missing(df, ["a", "z"]).collect()] == ["z"]
    compliance.record_run(df, str(tmp_path / "e"), "2026-01-01")
    compliance.record_run(df.filter("status = 'pass'"), str(tmp_path / "e"), "2026-01-02")
    (tmp_path / "e" / "part-odd.json").write_text('{"x": 1}\n')
    back = compliance.load_evidence(spark, str(tmp_path / "e"))
    assert back.count() == 5
    assert [(r["recorded_at"], r["percent"]) for r in compliance.trend(back).collect()] == [("2026-01-01", 50), ("2026-01-02", 100)]
    half = spark.createDataFrame([("a", "pass")] * 1 + [("b", "fail")] * 7, "control_id string, status string")
    assert compliance.score(half).first()["percent"] == 12  # halves go to even


def stix(kind, name, ext=None, **more):
    refs = [{"source_name": "mitre-attack", "external_id": ext}] if ext else []
    return {"type": kind, "id": f"{kind}--{name}", "name": name, "external_references": refs} | more


def test_graph(spark, tmp_path):
    def edge(kind, a, b):
        return {"type": "relationship", "id": f"r{a}{b}{kind}", "relationship_type": kind, "source_ref": a, "target_ref": b}

    objects = [stix("attack-pattern", "one", "T1"), stix("attack-pattern", "sub", "T1.1"), stix("attack-pattern", "old", "T0", revoked=True), stix("course-of-action", "fix", "M1"), stix("intrusion-set", "grp", "G1"), stix("tool", "tl", "S1"), stix("x-mitre-data-component", "dc")]
    objects += [stix("x-mitre-analytic", "an", x_mitre_log_source_references=[{"name": "log", "channel": "c", "x_mitre_data_component_ref": "x-mitre-data-component--dc"}]), stix("x-mitre-detection-strategy", "st", x_mitre_analytic_refs=["x-mitre-analytic--an"])]
    ap = "attack-pattern--"
    objects += [edge("subtechnique-of", ap + "sub", ap + "one"), edge("revoked-by", ap + "old", ap + "one"), edge("mitigates", "course-of-action--fix", ap + "one"), edge("uses", "intrusion-set--grp", ap + "one"), edge("uses", "tool--tl", ap + "one"), edge("detects", "x-mitre-detection-strategy--st", ap + "one")]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objects}))
    own = graph.bundle(spark, str(tmp_path / "b.json"))
    nodes, edges = graph.nodes(own), graph.edges(own)
    graph.require(own, ["attack-pattern"], ["uses", "detects"])
    with pytest.raises(ValueError):
        graph.require(own, ["campaign"], [])
    assert tuple(graph.parents(edges, nodes).first()) == ("T1.1", "T1")
    assert tuple(graph.successors(nodes, edges).first()) == ("T0", "T1")
    sets = graph.related_sets(edges, nodes).first()
    assert (sets["mitigations"], sets["groups"], sets["software"]) == (["fix"], ["grp"], ["tl"])
    found = graph.detections(own, nodes, edges).first()
    assert (found["log_sources"], found["data_components"]) == (["log:c"], ["dc"])
    chain = spark.createDataFrame([(f"T{i}", f"T{i + 1}") for i in range(10)] + [("A", "B"), ("B", "A")], "technique_id string, successor string")
    got = {r["technique_id"]: r for r in graph.resolved(chain).collect()}
    assert got["T0"]["current"] == "T10" and got["T0"]["n_hops"] == 10 and not got["T0"]["looped"] and got["A"]["looped"]
    assert graph.repeated(nodes, "id").count() == 0


def test_inventory(spark):
    random.seed(4)
    rows = [(g, i, random.randint(1, 30)) for g in "ab" for i in range(40)]
    got = {(r["g"], r["k"]): r["part"] for r in inventory.parts(spark.createDataFrame(rows, "g string, k int, n int"), "g", "k", "n", 50).collect()}
    for g in "ab":
        part = used = 0
        for _, k, n in (r for r in rows if r[0] == g):
            if used and used + n > 50:
                part, used = part + 1, 0
            used += n
            assert got[g, k] == part
    lock = inventory.pins(spark.createDataFrame([("Foo_Bar==1.0 \\",), ("# x",), ("baz==2 ; python_version > '3'",), (None,)], "value string"))
    assert {tuple(r) for r in lock.collect()} == {("foo-bar", "1.0"), ("baz", "2")}
    truth = spark.createDataFrame([("foo-bar", "1.1")], "name string, version string")
    assert {r["name"]: r["expected"] for r in inventory.drift(lock, truth).collect()} == {"foo-bar": "1.1", "baz": None}
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, text string")
    assert inventory.digest(files).first()["digest"] == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()


def test_npm(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"packages": {"": {"version": "0"}, "node_modules/@s/p": {"version": "1.0", "integrity": "sha256-AAAA"}, "node_modules/x/node_modules/@s/p": {"version": "1.0"}}}))
    rows = inventory.npm_components(spark, str(tmp_path / "l.json")).collect()
    assert [(r["name"], r["purl"]) for r in rows] == [("@s/p", "pkg:npm/%40s/p@1.0")]


def test_vulnerability(spark):
    rows = [("a", 9.0, None, "x", "yes", "no"), ("b", None, " HIGH ", "x", "1", "true"), (None, None, "odd", None, None, None), ("c", 11.0, "low", "y", "no", "no")]
    got = {r["id"]: (r["priority"], r["score"]) for r in vulnerability.ranked(spark.createDataFrame(rows, "id string, cvss double, severity string, asset string, exploit_available string, exposed string")).collect()}
    assert got == {"a": ("critical", 100), "b": ("high", 95), "UNKNOWN-ID": ("unknown", 10), "c": ("low", 20)}


def test_intake(spark):
    df = spark.createDataFrame([(1, "# A title here. More\n- one\n* two\nurgent: fix it; someday later\nwaiting on x"), (2, ""), (3, None)], "k int, text string")
    t = F.col("text")
    first = df.select(intake.title(t).alias("t"), intake.key_points(t).alias("p"), intake.category(t).alias("c"), intake.risk_flags(t).alias("r")).collect()
    assert first[0]["t"] == "A title here" and first[0]["p"] == ["one", "two"] and first[0]["c"] == "general" and first[1]["t"] == "Untitled Note"
    rows = intake.planned(intake.tasks(df, "k"), "k").collect()
    assert [(r["task"], r["priority"]) for r in rows][:2] == [("urgent: fix it", "high"), ("waiting on x", "high")] and rows[-1]["priority"] == "low"
    assert intake.tags(df, "k").filter("k = 1").first()["tags"][0] == "title"


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    (tmp_path / "kb" / "sub" / "a.md").write_text("alpha")
    (tmp_path / "kb" / "b.txt").write_text("beta")
    (tmp_path / "kb" / "c.bin").write_text("no")
    docs = readers.documents(spark, str(tmp_path / "kb"))
    assert {(r["source"], r["category"], r["text"]) for r in docs.collect()} == {("sub/a.md", "sub", "alpha"), ("b.txt", "root", "beta")}
    (tmp_path / "x.log").write_text("one\r\n\n  two \nthree")
    assert [tuple(r)[1:] for r in readers.log_lines(spark, str(tmp_path / "x.log"), 2).collect()] == [(0, "one"), (1, "two")]
    assert readers.unordered_lines(spark, str(tmp_path / "x.log")).count() == 3
    digest = hashlib.sha256(b"beta").hexdigest()
    assert readers.checked_bytes(spark, str(tmp_path / "kb" / "b.txt"), {"b.txt": digest}).count() == 1
    with pytest.raises(Exception, match="not as pinned"):
        readers.checked_bytes(spark, str(tmp_path / "kb" / "b.txt"), {"b.txt": "0"}).collect()
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert [r["a"] for r in readers.jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1, 2]
    chunks = retrieval.embedded(retrieval.chunks(docs))
    sinks.write_vectors(chunks, str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v")).count() == 2
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert {tuple(r) for r in sinks.keyed_overwrite(old, new, "k").collect()} == {(1, "o"), (2, "n"), (3, "n")}
    assert json.loads(sinks.canonical(new, "k"))[0] == {"k": 2, "v": "n"}


def test_approval_chain(spark):
    prev, rows = "sha256:0", []
    for i in range(4):
        payload = {"type": "submitted", "ref": f"r{i}", "n": i, "a": {"z": 1, "b": "q\"x"}}
        text = json.dumps({"decision_id": f"d{i}", "payload": payload, "prev": prev}, sort_keys=True, separators=(",", ":"))
        digest = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        rows.append([i + 1, f"d{i}", json.dumps(payload), prev, digest])
        prev = digest
    schema = "line long, decision_id string, payload string, prev_hash string, record_hash string"
    assert {r["problem"] for r in audit.queue_problems(spark.createDataFrame(rows, schema), "sha256:0").collect()} == {None}
    rows[2][1] = "other"
    assert [r["problem"] for r in audit.queue_problems(spark.createDataFrame(rows, schema), "sha256:0").orderBy("line").collect()] == [None, None, "hash mismatch", None]


def test_search_backends(spark):
    docs = spark.createDataFrame([("kb/a.md", "alpha beta"), ("kb/b.md", "zzz qqq"), ("other/c.md", "alpha beta")], "source string, text string")
    chunks = retrieval.chunks(docs)
    assert [(r["source"], r["backend"]) for r in retrieval.search(chunks, None, "alpha", category="kb").collect()] == [("kb/a.md", "lexical")]
    found = retrieval.search(chunks, retrieval.embedded(chunks), "alpha beta", 1).collect()
    assert [(r["source"], r["backend"]) for r in found] == [("kb/a.md", "vector")]
    assert retrieval.search(chunks, retrieval.embedded(chunks).filter("false"), "alpha").count() == 2


def test_vector_search_of_many_queries_in_blocks(spark):
    import numpy as np

    from emberwatch.plans import registry

    rng = np.random.default_rng(3)
    own = rng.normal(size=(1200, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :3]
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.vector_search(rows, asked).collect()}
    assert got == {(q, k + 1): int(best[q, k]) for q in range(1200) for k in range(3)}
    folder = "/root/testdata/sf0.001"
    ids = {r["vec_id"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    found = registry.QUERIES["vector_topk_hundredths"](spark, folder).collect()
    assert {r["query_id"] for r in found} == {i for i in ids if i % 100 == 0} and len(found) == 3 * len({r["query_id"] for r in found})


def test_vector_search_as_by_all_pairs_with_odd_vectors(spark, monkeypatch, capsys):
    """Copies, scores that differ by less than they are rounded to, nulls, zeros, keys of structs; no join of all with all by rows."""
    import numpy as np

    from emberwatch.functions.vector import cosine

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_SHARE", 20)
    monkeypatch.setattr(retrieval, "ROUGH", 50)
    rng = np.random.default_rng(5)
    own = rng.normal(size=(30, 5)).tolist() * 4
    own += [[1.0, 1e-7 * (9 - i), 0.0, 0.0, 0.0] for i in range(9)] + [[0.0] * 5, None, [1.0, None, 0.0, 0.0, 0.0]] + [[1.0, 0.0, 0.0, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<double>").repartition(3)
    asked = rows.filter("vec_id % 6 = 0 or vec_id >= 120").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    scored = rows.crossJoin(asked).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("s")).collect()
    want = {}
    for q in {r["query_id"] for r in scored}:
        best = sorted((r for r in scored if r["query_id"] == q), key=lambda r: (r["s"] is None, -round(r["s"] or 0, 9), r["vec_id"]))
        want |= {(q, n + 1): (r["vec_id"], r["s"]) for n, r in enumerate(best[:6])}
    found = retrieval.vector_search(rows, asked, 6)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()} == want
    keyed = rows.select(F.struct(F.lit("s").alias("source"), F.col("vec_id").alias("index")).alias("key"), "embedding")
    assert {(r["query_id"], r["rank"]): (r["key"]["index"], r["score"]) for r in retrieval.vector_search(keyed, asked, 6, key="key").collect()} == want
    found.explain()
    assert "NestedLoop" not in (plan := capsys.readouterr().out) and "Cartesian" not in plan
    with pytest.raises(PySparkException):
        retrieval.vector_search(rows, asked.limit(1).select("query_id", F.array(F.lit(1.0)).alias("query"))).collect()
    assert retrieval.vector_search(rows, asked.limit(0)).count() == 0 == retrieval.vector_search(rows.limit(0), asked).count()


def test_vectors_of_equal_rounded_scores_come_by_id(spark, tmp_path):
    from emberwatch.plans import registry

    own = [[1.0, 0.0]] + [[1.0, 1e-6 * (9 - k)] for k in range(1, 6)]
    rows = spark.createDataFrame([(100 + k, v) for k, v in enumerate(own)], "vec_id long, embedding array<double>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, most in (("vector_topk_hundredths", 3), ("vector_topk", 6)):
        found = registry.QUERIES[name](spark, str(tmp_path)).orderBy("rank").collect()
        assert [(r["query_id"], r["vec_id"]) for r in found] == [(100, 100 + k) for k in range(most)]
