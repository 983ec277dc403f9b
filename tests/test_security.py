import math

import pytest
from pyspark.sql import functions as F

from emberwatch.content import mapping_rules
from emberwatch.content.sigma_rules import BASE, BEHAVIOR, CORRELATION
from emberwatch.operators import correlation, detection, intel, mapping, ocsf, policy, response, risk, sequence, sigma, soc
from emberwatch.plans import pipeline


def logs(spark, lines, sequence_id="s"):
    return spark.createDataFrame([(sequence_id, i, x) for i, x in enumerate(lines)], "sequence_id string, idx long, raw string")


def triaged(spark, lines):
    return soc.triaged(soc.normalised_input(logs(spark, lines)))


def test_input_forms(spark):
    rows = soc.normalised_input(logs(spark, ['{"message": "hi", "user": null}', '{"a": "x", "b": 2}', "{bad", "  ", None, "plain"])).orderBy("idx").collect()
    assert [r["parse_status"] for r in rows] == ["structured", "structured", "malformed_json", "rejected", "rejected", "text"]
    assert rows[0]["text"] == "hi" and rows[0]["fields"]["user"] == "None"
    assert rows[1]["text"] == "x 2" and rows[5]["text"] == "plain"


@pytest.mark.parametrize(
    ("line", "kind", "level", "score", "source"),
    [
        ("Failed password for root from 10.0.0.5 port 22", "authentication failure", "high", 80, "10.0.0.5"),
        ("Failed password for bob from [2001:db8::1] multiple", "authentication failure", "medium", 55, "2001:db8::1"),
        ("arp: 10.0.0.9 moved from aa:bb to cc:dd from 10.0.0.9", "arp spoofing", "high", 70, "10.0.0.9"),
        ("usermod: add 'x' to group 'sudo'", "privileged group addition", "high", 70, None),
        ("useradd: new user: name=x", "account creation", "medium", 45, None),
        ("history -c by x", "log tampering", "high", 70, None),
        ("nmap from 1.2.3.4, done", "port scan", "medium", 45, "1.2.3.4"),
        ("suricata critical", "ids alert", "medium", 50, None),
        ("blocked from host.example", "firewall block", "low", 20, None),
        ("Accepted publickey for chroot from 1.2.3.4", "successful login", "low", 20, "1.2.3.4"),
        ("connection refused", "network anomaly", "low", 20, None),
        ("hello", "unknown security event", "unknown", 0, None),
        ('{"message": "Failed password", "severity": "critical", "src_host": "decoy"}', "authentication failure", "critical", 90, "decoy"),
    ],
)
def test_triage(spark, line, kind, level, score, source):
    r = triaged(spark, [line]).first()
    assert (r["event_type"], r["severity"], r["severity_score"], r["source"]) == (kind, level, score, source)


def test_sequences(spark):
    lines = ["Failed password for a from 1.1.1.1"] * 2 + ["Failed password for root from 1.1.1.1", "Accepted password for a from 1.1.1.1", "Accepted password for b from 2.2.2.2", "Failed password for b from 2.2.2.2", "useradd x"]
    events = triaged(spark, lines)
    found = {(r["source"], r["pattern"]): r for r in sequence.findings(events).collect()}
    assert set(found) == {("1.1.1.1", "brute_force"), ("1.1.1.1", "auth_failure_then_success")}
    assert found["1.1.1.1", "brute_force"]["severity"] == "critical" and found["1.1.1.1", "brute_force"]["evidence"] == [0, 1, 2]
    assert found["1.1.1.1", "auth_failure_then_success"]["evidence"] == [0, 1, 2, 3]
    rolled = sequence.roll_up(events, sequence.findings(events)).first()
    assert (rolled["severity"], rolled["severity_score"], rolled["uncorrelated_count"], rolled["anchor_idx"]) == ("critical", 100, 1, 2)
    arp = triaged(spark, ["arp spoof from 3.3.3.3"] * 3)
    assert [r["pattern"] for r in sequence.findings(arp).collect()] == ["arp_spoof_burst"]
    assert sequence.findings(events.filter("false")).count() == 0


def test_risk(spark):
    rows = spark.createDataFrame(
        [("a", "ids alert", 45.0, None), ("a", "ids alert", 45.0, None), ("a", "ids alert", 45.0, None), ("b", "log tampering", 70.0, 1000.0), ("c", "authentication failure", 49.0, 1000.0), ("c", "authentication failure", 70.0, 0.0), ("d", "x", 45.0, None), ("d", "w", 45.0, None)],
        "entity string, event_type string, score double, timestamp double",
    ).withColumn("idx", F.lit(0))
    got = {r["entity"]: r for r in risk.findings(rows, window_seconds=600).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["total"] == 94.5 and got["b"]["total"] == 105.0
    assert got["d"]["dominant_type"] == "w"
    with pytest.raises(Exception, match="no entity"):
        risk.validated(rows.withColumn("entity", F.lit(" "))).collect()


def test_sigma_conditions(spark):
    df = spark.createDataFrame([("a",), ("b",), ("ab",), (None,)], "message string")
    named = {"a": {"message|contains": "a"}, "b": {"message|contains": "B"}}

    def run(condition, **extra):
        return [r["x"] for r in df.select(sigma.compiled({"detection": named | extra | {"condition": condition}}, df.columns).alias("x")).collect()]

    assert run("a and not b") == [True, False, False, False]
    assert run("not a and b or a and b") == [False, True, True, False]
    assert run("not (a or b)") == [False, False, False, True]
    assert run("2 of s_*", s_1=named["a"], s_2=named["b"]) == [False, False, True, False]
    assert run("all of s_*", s_1=named["a"], s_2={"none": "x"}) == [False] * 4
    assert run("e", e={}) == [True] * 4
    for bad in ("a and", "(a", "c", "all of them", "0 of s_*", "a b", ""):
        with pytest.raises(sigma.RuleError):
            run(bad, s_1=named["a"])
    for extra in ({"message|re": "x"}, {"message": ["a", "b"]}, "text"):
        with pytest.raises(sigma.RuleError):
            run("x", x=extra)
    with pytest.raises(sigma.RuleError):
        sigma.compiled(CORRELATION[0], df.columns)


FIRES = {
    "ssh_failed_password": [("message", "Failed password for x")],
    "ssh_accepted_root_login": [("message", "Accepted password for root from x")],
    "firewall_block": [("message", "inbound denied")],
    "linux_local_account_created": [("message", "new user: x")],
    "account_added_to_privileged_group": [("message", "usermod: add 'x' to group 'wheel'")],
    "linux_command_history_cleared": [("message", "unset HISTFILE")],
    "network_port_scan": [("message", "masscan seen")],
    "arp_cache_poisoning": [("message", "arp 1.2.3.4 moved from a to b")],
    "auditd_stopped": [("message", "auditd was stopped")],
    "certutil_remote_download": [("command_line", "certutil -urlcache -f")],
    "cron_reboot_persistence": [("command_line", "crontab: @reboot x")],
    "memfd_fileless_execution": [("message", "memfd_create execveat")],
    "office_app_spawns_shell": [("parent_image", "WINWORD.EXE"), ("image", "cmd.exe")],
    "security_tool_tamper_command": [("command_line", "systemctl stop auditd")],
    "ssh_authorized_keys_appended": [("command_line", "echo k >> authorized_keys")],
}
QUIET = [{"message": "outbound denied"}, {"message": "arp moved from a, lease"}, {"message": "auditd restarting, was stopped"}, {"message": "user removed from group 'sudo'"}, {"command_line": "certutil -verify"}, {"parent_image": "explorer.exe", "image": "cmd.exe"}]


def test_rules_fire_as_they_should(spark):
    columns = ["message", "command_line", "image", "parent_image"]
    rows = [(n, *[dict(f).get(c) for c in columns]) for n, f in FIRES.items()] + [("", *[q.get(c) for c in columns]) for q in QUIET]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{c} string" for c in columns))
    for r in sigma.matches(df, BASE + BEHAVIOR).collect():
        assert r["rules"] == ([r["name"]] if r["name"] else []), r
    assert set(FIRES) == {r["name"] for r in BASE + BEHAVIOR}


def test_correlation_over_time(spark):
    rows = [(i, t, "k", m) for i, (t, m) in enumerate([(0, "Failed password"), (60, "Failed password"), (299, "Failed password"), (300, "Failed password"), (800, "Accepted x root y"), (950, "Accepted x root y"), (5000, "Failed password")])]
    rows.append((99, 10, None, "Failed password"))
    df = spark.createDataFrame(rows, "event_id long, s long, src_ip string, message string").withColumn("ts", F.timestamp_seconds("s"))
    hits = {r["name"]: sigma.compiled(r, df.columns) for r in BASE}
    rule = {"correlation": CORRELATION[0]["correlation"] | {"condition": {"gte": 4}}}
    assert [(r["event_id"], r["match_count"]) for r in correlation.run(rule, df, hits).collect()] == [(3, 4)]
    assert [(r["event_id"], r["first_ts"]) for r in correlation.run(CORRELATION[3], df, hits).collect()] == [(4, 300.0)]
    with pytest.raises(sigma.RuleError):
        correlation.run({"correlation": {"type": "odd", "rules": []}}, df, hits)


def test_mapping(spark):
    rows = [("authentication failure", ""), ("successful login", "ssh accepted"), ("ids alert", "x"), ("none", "arp spoof"), ("none", "nothing"), ("arp spoofing", "arp poison"), ("none", None)]
    df = spark.createDataFrame(rows, "event_type string, text string")
    got = mapping.mapped(df).collect()
    assert [r["primary"]["technique_id"] for r in got] == ["T1110", "T1078", "UNKNOWN", "T1557", "UNKNOWN", "T1557", "UNKNOWN"]
    assert [t["technique_id"] for t in got[1]["techniques"]] == ["T1078", "T1021.004"]
    assert got[5]["matched_rules"] == ["arp-spoofing-event", "arp-spoofing-log"] and len(got[5]["techniques"]) == 2
    with pytest.raises(ValueError):
        mapping.check_rules(mapping_rules.RULES + mapping_rules.RULES[:1])


def test_intel(spark):
    as_of = F.lit("2026-08-21").cast("date")
    values = spark.createDataFrame([("203.0.113.66",), ("198.51.100.77",), ("192.0.2.199",), ("169.254.169.254",), ("8.8.8.8",), ("BEACON.invalid",), ("fe80::1",), (None,)], "value string")
    got = {r["needle"]: (r["risk"], r["n_sources"]) for r in intel.verdicts(values, intel.atomic(spark), intel.sources(spark), as_of).collect()}
    assert got == {"203.0.113.66": ("malicious", 2), "198.51.100.77": ("suspicious", 1), "192.0.2.199": ("expired", 1), "169.254.169.254": ("suppressed", 0), "8.8.8.8": ("unknown", 0), "beacon.invalid": ("suspicious", 1), "fe80::1": ("suppressed", 0)}
    later = F.lit("2027-08-21").cast("date")
    assert {r["risk"] for r in intel.verdicts(values.filter("value = '203.0.113.66'"), intel.atomic(spark), intel.sources(spark), later).collect()} == {"expired"}
    kinds = spark.createDataFrame([("10.0.0.1",), ("100.64.0.1",), ("127.0.0.1",), ("169.254.1.1",), ("224.0.0.1",), ("9.9.9.9",), ("a.b",), ("abc",)], "v string")
    assert [r["k"] for r in kinds.select(intel.indicator_kind(F.col("v")).alias("k")).collect()] == ["private", "private", "loopback", "link_local", "multicast", "public", "domain", "unknown"]
    half = spark.range(1).select(intel.decayed(F.lit("ipv4"), F.lit("high"), F.date_sub(as_of, 30), F.date_add(as_of, 1), as_of).alias("x")).first()["x"]
    assert half == 0.5
    with pytest.raises(ValueError):
        intel.checked(intel.atomic(spark), ["type"], 100, intel.sources(spark))


def test_labels_and_classes(spark):
    df = spark.createDataFrame([("192.0.2.1", False, False), ("192.0.2.1", True, False), ("9.9.9.9", False, True), ("9.9.9.9", False, False)], "s string, c boolean, d boolean")
    assert [r["x"]["label"] for r in df.select(ocsf.source_label(F.col("s"), F.col("c"), F.col("d")).alias("x")).collect()] == ["benign-scanner", "malicious", "suspicious", "unknown"]
    pairs = spark.createDataFrame([("endpoint", "Execve"), ("identity", "user.session.start"), ("cloud", "x"), ("network", "odd"), ("email", None)], "s string, a string")
    got = [(r["x"]["class_uid"], r["x"]["mapped"]) for r in pairs.select(ocsf.of_activity(F.col("s"), F.col("a")).alias("x")).collect()]
    assert got == [(1007, True), (3002, True), (6003, False), (0, False), (4009, False)]


def test_policy(spark):
    df = spark.createDataFrame([("quarantine and delete it",), ("isolate host",), ("exploit it",), ("review logs",), ("dance",), ("pip install x",)], "a string").withColumn("c", policy.action_class(F.col("a")))
    got = df.select("c", policy.decision(F.col("c"), F.col("a"), allow=["DANCE", "exploit it"], deny=["review logs"]).alias("d")).collect()
    assert [(r["c"], r["d"]) for r in got] == [("destructive", "require_approval"), ("containment", "allow"), ("boundary_crossing", "deny"), ("read_only", "deny"), ("unknown", "allow"), ("dependency", "require_approval")]


def test_response(spark):
    techniques = spark.createDataFrame([(1, "T1110"), (2, "T1046"), (3, "T1557")], "k int, technique_id string")
    targets = spark.createDataFrame([(1, "h 1"), (1, "h2"), (2, "x")], "k int, target string")
    got = response.plans(techniques, targets, "k").orderBy("k", "place").select("k", "action_id", "target").collect()
    assert [tuple(r) for r in got][:2] == [(1, "capture-volatile-memory", "h-1"), (1, "capture-volatile-memory", "h2")]
    assert {r["k"] for r in got} == {1, 3} and got[-1]["target"] == "affected-host" and len(got) == 8


def test_detection_for_findings(spark):
    events = triaged(spark, ["Failed password for a from 1.1.1.1"] * 3)
    rules = detection.ranked(detection.for_findings(sequence.findings(events), detection.rule_table(spark, CORRELATION, "correlation")), "sequence_id")
    assert [r["rule_id"] for r in rules.orderBy("place").collect()] == ["ssh_bruteforce_then_success", "ssh_brute_force"]


def test_end_to_end(spark):
    lines = ["Failed password for root from 203.0.113.66"] * 3 + ["Accepted password for root from 203.0.113.66", "", "<b>|x"]
    out = pipeline.process_sequence(logs(spark, lines), F.lit("2026-08-21").cast("date"))
    assert out["sequences"].first()["rejected"] == 1
    assert {r["risk"] for r in out["verdicts"].collect()} == {"malicious"}
    assert out["risk"].first()["entity"] == "203.0.113.66"
    assert "brute" in out["reports"].first()["report"]
    from emberwatch.operators import report

    texts = [r["report"] for r in report.event_reports(out["events"], "2026-08-21").collect()]
    assert len(texts) == 5 and not any("<b>" in t for t in texts)


def test_mitigations(spark):
    rows = spark.createDataFrame([("isolate_host",), ("enable_account",), ("odd",), (None,)], "capability string")
    got = {r["capability"]: (r["primary"], r["mitigation_id"]) for r in response.mitigations(rows).collect()}
    assert got == {"isolate_host": ("isolate_host", "M1030"), "enable_account": ("disable_account", "M1026"), "odd": ("odd", None), None: (None, None)}


def test_running_totals_of_dense_windows(spark):
    """Totals as by adding up each row's window: many rows a second, borders of windows and stretches, negative and no times, no scores."""
    import random
    from decimal import Decimal

    rng = random.Random(4)
    times = [0.0, 9.5, 10.0, 11.0, 99.0, 100.0, 101.0, 109.9, 110.0, 111.0, 200.0, -0.5, -1.0, -100.0, -101.0, None]
    rows = [(rng.choice(["a", "b", None]), rng.choice(["port scan", "log tampering", "other"]), rng.choice([1.5, 2.0, None, 45.0]), rng.choice([*times, rng.uniform(-300, 300)]), k) for k in range(600)]
    rows += [("unscored", "other", None, 5.0, 600), ("unscored", "other", 3.0, 16.0, 601)]
    df = spark.createDataFrame(rows, "entity string, event_type string, score double, timestamp double, idx long")
    weights, second = {"port scan": "0.8", "log tampering": "1.5", "other": "1"}, lambda t: None if t is None else math.floor(t)
    want = {}
    for e, _, _, t, k in rows:
        near = [Decimal(str(s)) * Decimal(weights[y]) for f, y, s, u, _ in rows if f == e and s is not None and ((t is None and u is None) or (None not in (t, u) and 0 <= second(t) - second(u) <= 10))]
        want[k] = float(sum(near)) if near else None
    assert {r["idx"]: r["running_total"] for r in risk.running_totals(df, 10).collect()} == want


def test_running_totals_add_up_seconds_not_rows(spark, capsys):
    df = spark.range(10).select(F.lit("a").alias("entity"), F.lit("other").alias("event_type"), F.lit(1.0).alias("score"), F.lit(1.0).alias("timestamp"), F.col("id").alias("idx"))
    risk.running_totals(df, 10).explain()
    plan = capsys.readouterr().out
    assert "RangeFrame" not in plan and "unboundedpreceding" in plan.lower()
