"""Queries over telemetry: triage, correlation, risk, rules, mapping, intelligence, response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..content.intel_seed import NEVER_FLAG
from ..content.sigma_rules import BASE, BEHAVIOR, CORRELATION
from ..functions.net import in_any
from ..operators import correlation, detection, intel, mapping, ocsf, policy, response, risk, sequence, sigma, soc
from ..sources import vendors
from . import pipeline
from .adapter import LOGS_SQL, logs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2026-08-21"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _soc(sql: str) -> str:
    return f"WITH {LOGS_SQL} {sql}"


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soc.triaged(logs(spark, sf_dir))


@query("soc_triage", _soc("SELECT event_id, event_type, privileged, severity, severity_score, source, coalesce(source, '') AS indicators FROM soc"))
def soc_triage(spark, sf_dir):
    return triaged(spark, sf_dir).select("event_id", "event_type", "privileged", "severity", "severity_score", "source", F.array_join("indicators", ",").alias("indicators"))


@query("soc_evidence", _soc("""SELECT event_id, concat_ws(',', CASE WHEN contains(lower(text), 'root') THEN 'privileged_account' END, CASE WHEN event_type IN ('authentication failure', 'ids alert') THEN 'event_signal' END) AS fields,
  CAST(2 + CASE WHEN event_type IN ('authentication failure', 'successful login', 'account creation', 'port scan', 'ids alert') THEN 2 ELSE 0 END + CASE WHEN severity = 'high' THEN 1 ELSE 0 END AS BIGINT) AS n_actions FROM soc"""))
def soc_evidence(spark, sf_dir):
    df = triaged(spark, sf_dir)
    rows = soc.evidence(F.col("text"), F.col("fields"), F.col("event_type"))
    return df.select("event_id", F.array_join(F.transform(rows, lambda x: x["field"]), ",").alias("fields"), F.size(soc.recommended_actions(F.col("event_type"), F.col("severity"))).cast("long").alias("n_actions"))


FINDINGS_SQL = """
g AS (SELECT sequence_id, source, list(idx ORDER BY idx) FILTER (event_type = 'authentication failure') AS fails, list(idx ORDER BY idx) FILTER (event_type = 'successful login') AS logins,
      count(*) FILTER (event_type = 'authentication failure') AS n, coalesce(bool_or(privileged) FILTER (event_type = 'authentication failure'), false) AS priv FROM soc WHERE source IS NOT NULL GROUP BY ALL),
h AS (SELECT *, list_min(list_filter(logins, lambda x: x > fails[1])) AS login FROM g),
f AS (SELECT sequence_id, source, 'brute_force' AS pattern, CASE WHEN priv THEN 'critical' ELSE 'high' END AS severity, n AS event_count, array_to_string(fails, ',') AS evidence FROM h WHERE n >= 3
      UNION ALL SELECT sequence_id, source, 'auth_failure_then_success', 'critical', len(list_filter(fails, lambda x: x < login)) + 1, array_to_string(list_append(list_filter(fails, lambda x: x < login), login), ',') FROM h WHERE login IS NOT NULL)
"""


@query("soc_findings", f"WITH {LOGS_SQL}, {FINDINGS_SQL} SELECT sequence_id, source, pattern, severity, CAST(event_count AS BIGINT) AS event_count, evidence FROM f")
def soc_findings(spark, sf_dir):
    return sequence.findings(triaged(spark, sf_dir)).select("sequence_id", "source", "pattern", "severity", "event_count", F.array_join("evidence", ",").alias("evidence"))


@query("soc_sequence_rollup", f"""WITH {LOGS_SQL}, {FINDINGS_SQL},
e AS (SELECT sequence_id, count(*) AS event_count, count(*) FILTER (source IS NULL) AS uncorrelated_count, max(struct_pack(r := base, s := severity_score, n := -idx)) AS top, max(struct_pack(s := severity_score, n := -idx)) AS anchor FROM soc GROUP BY 1),
b AS (SELECT sequence_id, count(*) AS finding_count, max(CASE severity WHEN 'critical' THEN 90 ELSE 70 END) AS r FROM f GROUP BY 1)
SELECT e.sequence_id, CAST(event_count AS BIGINT) AS event_count, CAST(uncorrelated_count AS BIGINT) AS uncorrelated_count, CAST(coalesce(finding_count, 0) AS BIGINT) AS finding_count, t.event_type AS top_event_type, CAST(-e.anchor.n AS BIGINT) AS anchor_idx,
CASE WHEN b.r >= top.r THEN CASE b.r WHEN 90 THEN 'critical' ELSE 'high' END ELSE t.severity END AS severity, CAST(CASE WHEN b.r IS NULL THEN top.s ELSE greatest(least(b.r + 10, 100), top.s) END AS INTEGER) AS severity_score
FROM e LEFT JOIN b USING (sequence_id) JOIN soc t ON t.idx = -e.top.n""")
def soc_sequence_rollup(spark, sf_dir):
    df = triaged(spark, sf_dir)
    return sequence.roll_up(df, sequence.findings(df)).select("sequence_id", "event_count", "uncorrelated_count", "finding_count", "top_event_type", "anchor_idx", "severity", "severity_score")


WEIGHT_SQL = "CASE event_type WHEN 'successful login' THEN 1.2 WHEN 'port scan' THEN 0.8 WHEN 'ids alert' THEN 0.7 WHEN 'firewall block' THEN 0.6 WHEN 'unknown security event' THEN 0.5 ELSE 1.0 END"
RISK_SQL = f"p AS (SELECT entity, event_type, sum(CAST(score * w AS DECIMAL(18,4))) AS part, count(*) AS n FROM (SELECT entity, event_type, severity_score AS score, {WEIGHT_SQL} AS w FROM near) GROUP BY ALL)"


@query("risk_findings", f"""WITH {LOGS_SQL}, near AS (SELECT *, coalesce(source, 'unknown') AS entity FROM soc), {RISK_SQL}
SELECT entity, CAST(sum(part) AS DOUBLE) AS total, arg_max(event_type, (part, -ascii(event_type))) AS dominant_type, CAST(sum(n) AS BIGINT) AS n_events, CAST(count(*) AS BIGINT) AS distinct_types FROM p GROUP BY 1 HAVING sum(part) >= 90""")
def risk_findings(spark, sf_dir):
    """Entity risk over the whole history (contributions carry no timestamps, so no window filters)."""
    return risk.findings(risk.contributions(triaged(spark, sf_dir)))


WEEK = 7 * 86_400


@query("risk_windowed", f"""WITH {LOGS_SQL}, k AS (SELECT *, coalesce(source, 'unknown') AS entity, epoch(ts) AS s FROM soc), m AS (SELECT entity, max(s) AS newest FROM k GROUP BY 1), near AS (SELECT k.* FROM k JOIN m USING (entity) WHERE newest - s <= {WEEK}), {RISK_SQL}
SELECT entity, CAST(sum(part) AS DOUBLE) AS total, CAST(sum(n) AS BIGINT) AS n_events FROM p GROUP BY 1 HAVING sum(part) >= 150""")
def risk_windowed(spark, sf_dir):
    rows = risk.contributions(triaged(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("timestamp").cast("double")))
    return risk.findings(rows, threshold=150.0, window_seconds=WEEK).select("entity", "total", "n_events")


@query("risk_running", f"""WITH {LOGS_SQL}, k AS (SELECT idx, coalesce(source, 'unknown') AS entity, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(severity_score * {WEIGHT_SQL} AS DECIMAL(18,4)) AS v FROM soc)
SELECT idx, entity, CAST(sum(v) OVER (PARTITION BY entity ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total FROM k""")
def risk_running(spark, sf_dir):
    rows = risk.contributions(triaged(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("timestamp").cast("double")))
    return risk.running_totals(rows, 86_400).select("idx", "entity", "running_total")


@query("sigma_base_hits", _soc("""SELECT event_id, concat_ws(',', CASE WHEN contains(text, 'Failed password') THEN 'ssh_failed_password' END, CASE WHEN starts_with(text, 'Accepted') AND contains(text, ' root ') THEN 'ssh_accepted_root_login' END,
  CASE WHEN contains(text, 'blocked') THEN 'firewall_block' END, CASE WHEN contains(text, 'useradd') THEN 'linux_local_account_created' END, CASE WHEN contains(text, 'nmap') THEN 'network_port_scan' END) AS rules FROM soc"""))
def sigma_base_hits(spark, sf_dir):
    return sigma.matches(logs(spark, sf_dir), BASE).select("event_id", F.array_join("rules", ",").alias("rules"))


SPECIAL = {
    "name": "special",
    "detection": {"sel_root": {"message|contains": " ROOT "}, "sel_ssh": {"message|endswith": "ssh2"}, "sel_fail": {"message|startswith": "failed"}, "noise": {"src_ip": "203.0.113.10"}, "pair": {"message|contains|all": ["nmap", "alert"]}, "condition": "(2 of sel_* and not noise) or (pair and not all of sel_*)"},
}


@query("sigma_conditions", _soc("""SELECT event_id, text FROM soc WHERE (((contains(text, ' root '))::INT + (ends_with(text, 'ssh2'))::INT + (starts_with(text, 'Failed'))::INT >= 2) AND src_ip <> '203.0.113.10') OR (contains(text, 'nmap') AND contains(text, 'alert'))"""))
def sigma_conditions(spark, sf_dir):
    df = logs(spark, sf_dir)
    return df.filter(sigma.compiled(SPECIAL, df.columns)).select("event_id", "text")


DAYS = 3 * 86_400


@query("corr_event_count", _soc(f"""SELECT event_id, src_ip, match_count FROM (SELECT event_id, src_ip, count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN {DAYS * 10**6} PRECEDING AND CURRENT ROW) AS match_count FROM soc WHERE contains(text, 'Failed password')) WHERE match_count >= 3"""))
def corr_event_count(spark, sf_dir):
    """The brute-force correlation with a timespan of three days and three matches, as the test events are sparse."""
    df = logs(spark, sf_dir)
    hit = sigma.compiled(BASE[0], df.columns)
    return correlation.event_count(df, hit, ["src_ip"], "3d", 3).select("event_id", "src_ip", "match_count")


@query("corr_temporal_ordered", _soc(f"""SELECT b.event_id, b.src_ip, max(epoch_us(a.ts)) / 1e6 AS first_ts FROM soc b JOIN soc a ON a.src_ip = b.src_ip AND (a.ts, a.event_id) < (b.ts, b.event_id) AND epoch_us(b.ts) - epoch_us(a.ts) <= {DAYS * 10**6}
WHERE contains(a.text, 'Failed password') AND starts_with(b.text, 'Accepted') AND contains(b.text, ' root ') GROUP BY ALL"""))
def corr_temporal_ordered(spark, sf_dir):
    df = logs(spark, sf_dir)
    hits = {r["name"]: sigma.compiled(r, df.columns) for r in BASE}
    rule = {"correlation": CORRELATION[3]["correlation"] | {"timespan": "3d"}}
    return correlation.run(rule, df, hits).select("event_id", "src_ip", "first_ts")


TECHNIQUE_SQL = "CASE event_type WHEN 'authentication failure' THEN 'T1110' WHEN 'successful login' THEN 'T1078' WHEN 'account creation' THEN 'T1136.001' WHEN 'port scan' THEN 'T1046' ELSE 'UNKNOWN' END"


@query("mapping_primary", _soc(f"""SELECT event_id, {TECHNIQUE_SQL} AS technique_id,
CASE event_type WHEN 'authentication failure' THEN 'credential-access' WHEN 'successful login' THEN 'initial-access' WHEN 'account creation' THEN 'persistence' WHEN 'port scan' THEN 'discovery' WHEN 'ids alert' THEN 'Detection-dependent' ELSE 'Unknown' END AS tactic,
CASE WHEN event_type IN ('authentication failure', 'successful login', 'account creation', 'port scan') THEN 'medium' ELSE 'low' END AS confidence,
CASE event_type WHEN 'successful login' THEN 'T1078,T1021.004' WHEN 'firewall block' THEN '' WHEN 'ids alert' THEN '' ELSE {TECHNIQUE_SQL} END AS techniques FROM soc"""))
def mapping_primary(spark, sf_dir):
    return mapping.mapped(triaged(spark, sf_dir)).select("event_id", "primary.technique_id", "primary.tactic", "primary.confidence", F.array_join("techniques.technique_id", ",").alias("techniques"))


@query("mapping_merged", _soc("""SELECT sequence_id, technique_id, min(idx) AS first_idx, count(*) AS n FROM (SELECT sequence_id, idx, unnest(CASE event_type WHEN 'authentication failure' THEN ['T1110'] WHEN 'successful login' THEN ['T1078', 'T1021.004'] WHEN 'account creation' THEN ['T1136.001'] WHEN 'port scan' THEN ['T1046'] ELSE [] END) AS technique_id FROM soc) GROUP BY ALL"""))
def mapping_merged(spark, sf_dir):
    return mapping.merged_over_rows(mapping.mapped(triaged(spark, sf_dir)), "sequence_id").select("sequence_id", "technique_id", "first_idx", "n")


@query("detection_match", f"""WITH {LOGS_SQL}, {FINDINGS_SQL}, r(rule_id, lvl, t) AS (VALUES ('ssh_brute_force', 1, ['T1110']), ('ssh_bruteforce_then_success', 0, ['T1110', 'T1078'])),
m AS (SELECT DISTINCT sequence_id, rule_id, lvl, replace(rule_id, '_', ' ') AS title FROM f, r WHERE list_has_any(t, CASE pattern WHEN 'brute_force' THEN ['T1110'] ELSE ['T1110', 'T1078'] END))
SELECT sequence_id, rule_id, CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY lvl, title, rule_id) AS INTEGER) AS place FROM m""")
def detection_match(spark, sf_dir):
    found = sequence.findings(triaged(spark, sf_dir))
    rules = detection.for_findings(found, detection.rule_table(spark, CORRELATION, "correlation"))
    return detection.ranked(rules, "sequence_id").select("sequence_id", "rule_id", "place")


@query("detection_coverage", "SELECT * FROM (VALUES ('T1110', 1::BIGINT), ('T1078', 1), ('T1595', 1), ('T1136.001', 1), ('T1098', 1), ('T1070.003', 1), ('T1046', 1), ('T1557', 1), ('T1557.002', 1), ('T1685', 2), ('T1105', 1), ('T1053.003', 1), ('T1620', 1), ('T1204.002', 1), ('T1059.001', 1), ('T1098.004', 1)) t(technique_id, n_rules)")
def detection_coverage(spark, sf_dir):
    return detection.coverage(detection.rule_table(spark, BASE + BEHAVIOR, "event")).select("technique_id", "n_rules")


@query("ocsf_event", _soc("""SELECT event_id, CAST(CASE event_type WHEN 'authentication failure' THEN 3002 WHEN 'successful login' THEN 3002 WHEN 'account creation' THEN 3001 WHEN 'firewall block' THEN 4001 WHEN 'port scan' THEN 4001 WHEN 'ids alert' THEN 2004 ELSE 0 END AS INTEGER) AS class_uid, true AS mapped FROM soc"""))
def ocsf_event(spark, sf_dir):
    return triaged(spark, sf_dir).withColumn("o", ocsf.of_type(F.col("event_type"))).select("event_id", "o.class_uid", "o.mapped")


@query("ocsf_source_activity", """SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 4002 WHEN 'error' THEN 3002 WHEN 'signup' THEN 3001 WHEN 'click' THEN 6003 ELSE 0 END AS INTEGER) AS class_uid, event_type IN ('view', 'error', 'signup') AS mapped FROM events""")
def ocsf_source_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    domain = F.when(kind == "view", "network").when(kind == "click", "cloud").when(kind == "purchase", "endpoint").otherwise("identity")
    activity = F.when(kind == "view", "http").when(kind == "error", "User.Session.start").when(kind == "signup", "user.lifecycle.create").otherwise(kind)
    return e.withColumn("o", ocsf.of_activity(domain, activity)).select("event_id", "o.class_uid", "o.mapped")


@query("policy_decision", """SELECT event_id, CASE event_type WHEN 'error' THEN 'secret_handling' WHEN 'purchase' THEN 'boundary_crossing' WHEN 'signup' THEN 'read_only' WHEN 'view' THEN 'containment' ELSE 'unknown' END AS action_class,
CASE event_type WHEN 'purchase' THEN 'deny' WHEN 'signup' THEN 'allow' WHEN 'view' THEN 'allow' WHEN 'click' THEN CASE WHEN user_id = 7 THEN 'allow' ELSE 'require_approval' END ELSE 'require_approval' END AS decision FROM events""")
def policy_decision(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind, who = F.col("event_type"), F.col("user_id").cast("string")
    action = F.when(kind == "error", F.concat(F.lit("Rotate key and token of "), who)).when(kind == "purchase", F.concat(F.lit("exploit and delete "), who)).when(kind == "signup", F.concat(F.lit("review "), who)).when(kind == "view", F.concat(F.lit("Isolate host "), who)).otherwise(F.concat(F.lit("ping "), who))
    own = e.select("event_id", action.alias("action")).withColumn("action_class", policy.action_class(F.col("action")))
    return own.select("event_id", "action_class", policy.decision(F.col("action_class"), F.col("action"), allow=["ping 7"]).alias("decision"))


ADDRESS_SQL = "CASE user_id % 8 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '172.20.1.' WHEN 2 THEN '100.100.7.' WHEN 3 THEN '127.0.0.' WHEN 4 THEN '169.254.9.' WHEN 5 THEN '224.0.0.' WHEN 6 THEN '203.0.113.' ELSE 'host.example.' END || (user_id % 250)"


def _addresses(spark, sf_dir) -> DataFrame:
    starts = ["10.0.0.", "172.20.1.", "100.100.7.", "127.0.0.", "169.254.9.", "224.0.0.", "203.0.113.", "host.example."]
    start = F.element_at(F.array(*map(F.lit, starts)), (F.col("user_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(start, (F.col("user_id") % 250).cast("string")).alias("value"))


@query("indicator_kind", f"SELECT event_id, {ADDRESS_SQL} AS value, CASE user_id % 8 WHEN 3 THEN 'loopback' WHEN 4 THEN 'link_local' WHEN 5 THEN 'multicast' WHEN 6 THEN 'public' WHEN 7 THEN 'domain' ELSE 'private' END AS kind, user_id % 8 < 6 AS never_flag FROM events")
def indicator_kind(spark, sf_dir):
    return _addresses(spark, sf_dir).select("event_id", "value", intel.indicator_kind(F.col("value")).alias("kind"), in_any(F.col("value"), NEVER_FLAG).alias("never_flag"))


@query("intel_verdicts", f"""WITH v AS (SELECT DISTINCT {ADDRESS_SQL} AS needle, user_id % 8 AS k FROM events UNION SELECT * FROM (VALUES ('203.0.113.66', 6), ('198.51.100.77', 6), ('192.0.2.199', 6), ('beacon.invalid', 6)) t(needle, k))
SELECT needle, CASE WHEN k < 6 THEN 'suppressed' WHEN needle = '203.0.113.66' THEN 'malicious' WHEN needle IN ('198.51.100.77', 'beacon.invalid') THEN 'suspicious' WHEN needle = '192.0.2.199' THEN 'expired' ELSE 'unknown' END AS risk,
CASE needle WHEN '203.0.113.66' THEN round(pow(2, -7/30.0), 4) WHEN '198.51.100.77' THEN round(pow(2, -7/30.0), 4) WHEN 'beacon.invalid' THEN round(0.6 * pow(2, -3/90.0), 4) ELSE 0.0 END::DOUBLE AS decayed_score,
CASE WHEN needle = '203.0.113.66' THEN 2 WHEN needle IN ('198.51.100.77', '192.0.2.199', 'beacon.invalid') THEN 1 ELSE 0 END::INTEGER AS n_sources FROM v GROUP BY ALL""")
def intel_verdicts(spark, sf_dir):
    more = spark.createDataFrame([("203.0.113.66",), ("198.51.100.77",), ("192.0.2.199",), ("BEACON.invalid",)], "value string")
    values = _addresses(spark, sf_dir).select("value").unionByName(more)
    return intel.verdicts(values, intel.atomic(spark), intel.sources(spark), F.lit(AS_OF).cast("date")).select("needle", "risk", "decayed_score", "n_sources")


@query("intel_decay", """SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE (CASE p_size % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.6 ELSE 1.0 END) * pow(2, -(p_size * 3) / (CASE p_size % 4 WHEN 0 THEN 14.0 WHEN 1 THEN 30.0 WHEN 2 THEN 90.0 ELSE 365.0 END)) END, 6) AS score FROM part""")
def intel_decay(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, as_of = F.col("p_size").cast("int"), F.lit(AS_OF).cast("date")
    kind = F.element_at(F.array(*map(F.lit, ("url", "ipv4", "domain", "sha256"))), size % 4 + 1)
    confidence = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), size % 3 + 1)
    retrieved, expires = F.date_sub(as_of, size * 3), F.when(size % 7 == 0, F.date_sub(as_of, 1)).otherwise(F.date_add(as_of, 1))
    return p.select("p_partkey", F.round(intel.decayed(kind, confidence, retrieved, expires, as_of), 6).alias("score"))


@query("behavior_matches", _soc("""SELECT event_id, CASE event_type WHEN 'authentication failure' THEN 'bhv-ssh-password-spray' WHEN 'account creation' THEN 'bhv-persistence-account-chain' ELSE 'bhv-service-discovery-sweep' END AS behavior_id, CASE event_type WHEN 'account creation' THEN 'stale_anchor' ELSE 'active' END AS status
FROM soc WHERE event_type IN ('authentication failure', 'account creation', 'port scan')"""))
def behavior_matches(spark, sf_dir):
    corpus = spark.createDataFrame([("T1110", "active"), ("T1046", "active"), ("T1136.001", "active"), ("T1098", "revoked"), ("T1070.003", "active")], "technique_id string, status string")
    records = intel.behavior_status(intel.behaviors(spark), corpus, F.lit(AS_OF).cast("date"))
    return intel.behavior_matches(triaged(spark, sf_dir), records).select("event_id", "behavior_id", "status")


@query("source_labels", _soc("""SELECT source, bool_or(false) AS from_canary, 'unknown' AS label FROM soc WHERE source IS NOT NULL GROUP BY 1"""))
def source_labels(spark, sf_dir):
    return ocsf.labelled_sources(triaged(spark, sf_dir)).select("source", "from_canary", "label")


@query("response_plan", _soc("""SELECT DISTINCT event_id, a.action_id, src_ip AS target FROM soc JOIN (VALUES ('authentication failure', ['capture-volatile-memory', 'revoke-account-sessions', 'reset-account-credentials']), ('successful login', ['capture-volatile-memory', 'revoke-account-sessions', 'reset-account-credentials'])) m(event_type, actions) USING (event_type), unnest(actions) a(action_id)
UNION SELECT event_id, a, 'affected-host' FROM soc, unnest(['capture-volatile-memory', 'revoke-account-sessions']) t(a) WHERE event_type = 'account creation'"""))
def response_plan(spark, sf_dir):
    return pipeline.response_plans(mapping.mapped(triaged(spark, sf_dir))).select("event_id", "action_id", "target")


@query("response_plan_ids", """SELECT event_id, substr(sha256('T1110' || chr(0) || '|' || chr(0) || 'host' || user_id || chr(0)), 1, 16) AS plan_id FROM events WHERE event_type = 'error'""")
def response_plan_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    targets = e.select("event_id", F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("target"))
    return response.plan_ids(e.select("event_id", F.lit("T1110").alias("technique_id")), targets, "event_id")


@query("vendor_normalised", """SELECT event_id, CASE event_type WHEN 'view' THEN 'suricata' WHEN 'error' THEN 'okta' WHEN 'purchase' THEN 'auditd' WHEN 'signup' THEN 'unrecognized' ELSE 'unrecognized' END AS vendor,
CASE event_type WHEN 'view' THEN 'suricata dns 10.0.0.' || (user_id % 250) || ':53 -> 198.51.100.9:' || (user_id % 1000) || ' query=q' || user_id || '.example' WHEN 'error' THEN 'okta user.session.start actor=u' || user_id || '@corp.example outcome=FAILURE'
 WHEN 'purchase' THEN 'auditd EXECVE exe=/bin/sh cmd=sh -c u' || user_id WHEN 'signup' THEN '{"a": [1, ' || user_id ELSE 'plain line ' || user_id END AS message,
CASE WHEN event_type IN ('view', 'error', 'purchase') THEN 'structured' WHEN event_type = 'signup' THEN 'partial' ELSE 'text' END AS parse_status FROM events""")
def vendor_normalised(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind, u = F.col("event_type"), F.col("user_id").cast("string")
    stamp = F.lit("2026-08-14T09:31:44Z")
    suricata = F.format_string('{"event_type":"dns","timestamp":"%s","src_ip":"10.0.0.%d","src_port":53,"dest_ip":"198.51.100.9","dest_port":%d,"dns":{"rrname":"q%s.example"}}', stamp, F.col("user_id") % 250, F.col("user_id") % 1000, u)
    okta = F.format_string('{"eventType":"user.session.start","published":"%s","actor":{"alternateId":"u%s@corp.example"},"outcome":{"result":"FAILURE"}}', stamp, u)
    audit = F.format_string('{"type":"EXECVE","@timestamp":"%s","exe":"/bin/sh","a0":"sh","a2":"u%s","a1":"-c"}', stamp, u)
    raw = F.when(kind == "view", suricata).when(kind == "error", okta).when(kind == "purchase", audit).when(kind == "signup", F.concat(F.lit('{"a": [1, '), u)).otherwise(F.concat(F.lit("plain line "), u))
    return vendors.normalised(e.select("event_id", raw.alias("raw"))).select("event_id", "event.vendor", "event.message", "event.parse_status")


TRIAGE_SQL = f"""t AS (SELECT *, concat_ws(',', CASE WHEN contains(text, 'Failed password') THEN 'ssh_failed_password' END, CASE WHEN starts_with(text, 'Accepted') AND contains(text, ' root ') THEN 'ssh_accepted_root_login' END,
  CASE WHEN contains(text, 'blocked') THEN 'firewall_block' END, CASE WHEN contains(text, 'useradd') THEN 'linux_local_account_created' END, CASE WHEN contains(text, 'nmap') THEN 'network_port_scan' END) AS rules,
  CASE event_type WHEN 'successful login' THEN 'T1078,T1021.004' WHEN 'firewall block' THEN '' WHEN 'ids alert' THEN '' ELSE {TECHNIQUE_SQL} END AS techniques,
  CAST(CASE event_type WHEN 'authentication failure' THEN 3002 WHEN 'successful login' THEN 3002 WHEN 'account creation' THEN 3001 WHEN 'firewall block' THEN 4001 WHEN 'port scan' THEN 4001 WHEN 'ids alert' THEN 2004 ELSE 0 END AS INTEGER) AS class_uid,
  CAST(contains(lower(text), 'root') AS INTEGER) + CAST(event_type IN ('authentication failure', 'ids alert') AS INTEGER) AS n_evidence FROM soc)"""


@query("process_log", _soc(f", {TRIAGE_SQL} SELECT event_id, event_type, severity, severity_score, source, rules, techniques, class_uid, n_evidence FROM t").replace(" ,", ",", 1))
def process_log(spark, sf_dir):
    """Whole triage of each log line; returns scalars."""
    df = pipeline.process_log(logs(spark, sf_dir).drop("text", "fields", "parse_status", "message"))
    return df.select("event_id", "event_type", "severity", "severity_score", "source", F.array_join("rules", ",").alias("rules"), F.array_join("techniques.technique_id", ",").alias("techniques"), "ocsf.class_uid", F.size("evidence").alias("n_evidence"))


@query("sequence_reports", f"""WITH {LOGS_SQL}, {FINDINGS_SQL},
e AS (SELECT sequence_id, count(*) AS event_count, count(*) FILTER (source IS NULL) AS uncorrelated_count, max(struct_pack(r := base, s := severity_score, n := -idx)) AS top FROM soc GROUP BY 1),
b AS (SELECT sequence_id, count(*) AS finding_count, max(CASE severity WHEN 'critical' THEN 90 ELSE 70 END) AS r,
      string_agg('- ' || replace(pattern, '_', '\\_') || ' from ' || source || ' severity ' || severity || ' events ' || event_count, chr(10)) AS body FROM f GROUP BY 1),
o AS (SELECT e.sequence_id, event_count, uncorrelated_count, coalesce(finding_count, 0) AS finding_count, coalesce(body, 'none') AS body, CASE WHEN b.r >= top.r THEN CASE b.r WHEN 90 THEN 'critical' ELSE 'high' END ELSE t.severity END AS severity,
      CAST(CASE WHEN b.r IS NULL THEN top.s ELSE greatest(least(b.r + 10, 100), top.s) END AS INTEGER) AS severity_score FROM e LEFT JOIN b USING (sequence_id) JOIN soc t ON t.idx = -e.top.n)
SELECT sequence_id, severity, severity_score, finding_count, CAST(0 AS BIGINT) AS rejected, CAST(length('# Sequence report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- events: ' || event_count || chr(10) || '- severity: ' || severity || chr(10)
|| '- score: ' || severity_score || chr(10) || '- without source: ' || uncorrelated_count || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || body || chr(10)) AS INTEGER) AS report_chars FROM o""")
def sequence_reports(spark, sf_dir):
    out = pipeline.process_sequence(logs(spark, sf_dir).select("sequence_id", "idx", "raw"), F.lit(AS_OF).cast("date"))
    return out["reports"].select("sequence_id", "severity", "severity_score", "finding_count", "rejected", F.length("report").alias("report_chars"))
