"""Triage and correlation of lines of every kind: text, JSON with fields, broken JSON, blank ones; SQL with rule tables of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..operators import sequence, soc
from .adapter import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


#: Lines by event_id, with the user's number as %U and that of an address as %A.
LINES = [
    "Failed password for root from 203.0.113.%A port 22 ssh2",
    "Failed password for u%U from 203.0.113.%A port 22 ssh2",
    "arpwatch: 192.0.2.%A moved from 02:00:00:00:00:01 to 02:00:00:00:00:02",
    '{"message": "arp reply, duplicate address", "src_ip": "192.0.2.%A", "host": "sw%U"}',
    "bash: history -c by u%U",
    "auditd was stopped on h%U",
    "usermod: u%U added to group sudo",
    '{"timestamp": "2026-01-01T00:00:00Z", "host": "h%U", "user": "Administrator", "source_ip": "198.51.100.%A", "severity": "Critical", "message": "session opened"}',
    '{"message": "Failed password for u%U from 203.0.113.%A port 22"',
    '["Invalid user u%U"]',
    '{"event": "port scan", "remote_addr": "203.0.113.%A", "n": 3}',
    "connection refused by (203.0.113.%A), from 198.51.100.%A;",
    "  ",
    '{"user": "u%U", "account": "root", "message": "multiple Failed password", "ip": "203.0.113.%A", "severity": "odd"}',
    "CRITICAL: Invalid user admin from [203.0.113.%A]; brute force",
    "Accepted publickey for root from 203.0.113.%A",
    '{"account": "admin", "message": "Accepted password", "src_ip": "203.0.113.%A", "severity": null}',
    "log file cleared on h%U from 198.51.100.%A",
    "new account u%U; alert raised",
    "Suricata deny from 203.0.113.%A to 192.0.2.1,192.0.2.2",
    "group wheel: gpasswd -a u%U",
    "masscan or timeout",
    "firewall deny from host9 from 203.0.113.%A",
    "timeout after 30 s",
    '{"message": "ARP cache poison", "source_ip": "192.0.2.%A", "src_ip": "192.0.2.%A", "user": "root"}',
    "nothing to see, administrators only",
]


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of LINES, triaged; sequences are thousands of events."""
    e = table(spark, sf_dir, "events")
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("event_id") % len(LINES) + 1).cast("int"))
    raw = F.replace(F.replace(line, F.lit("%U"), F.col("user_id").cast("string")), F.lit("%A"), (F.floor(F.col("event_id") / len(LINES)) % 5).cast("string"))
    own = e.select("event_id", F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 1000).cast("string").alias("sequence_id"), raw.alias("raw"))
    return soc.triaged(soc.normalised_input(own))


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What correlation needs of mixed(), triaged once."""
    return kept(mixed(spark, sf_dir).select("sequence_id", "idx", "source", "event_type", "privileged", "severity", "severity_score", "parse_status"))


#: Words by class: each group needs one. The first class of which all groups have one holds.
WORDS = [
    ("authentication failure", ["failed password", "invalid user"]),
    ("arp spoofing", ["arp"], ["moved from", "is using my ip", "spoof", "poison", "duplicate"]),
    ("log tampering", ["history -c", ".bash_history", "log file cleared"]),
    ("log tampering", ["auditd"], ["stopped", "disabled"]),
    ("privileged group addition", ["group"], ["sudo", "wheel", "admin", "adm"], ["usermod", "gpasswd", "added"]),
    ("account creation", ["useradd", "new user", "new account"]),
    ("port scan", ["nmap", "port scan", "portscan", "masscan"]),
    ("ids alert", ["suricata", "alert"]),
    ("firewall block", ["blocked", "deny"]),
    ("successful login", ["accepted password", "accepted publickey"]),
    ("network anomaly", ["connection refused", "timeout"]),
]


def _sql(rest: str) -> str:
    lines = ", ".join(f"({k}, '{x}')" for k, x in enumerate(LINES))
    words = ", ".join(f"({r}, '{kind}', {g}, '{w}')" for r, (kind, *groups) in enumerate(WORDS) for g, own in enumerate(groups) for w in own)
    field = "CASE WHEN list_contains(json_keys(js), '{0}') THEN coalesce(json_extract_string(js, '$.{0}'), 'None') END"
    names = ["timestamp", "host", "user", "account", "src_ip", "source_ip", "ip", "remote_addr", "src_host", "severity", "message"]
    fields = ", ".join(f"{field.format(n)} AS f_{n}" for n in names)
    shown = ", ".join(f"'{n}=' || f_{n}" for n in ("timestamp", "host", "user", "src_ip", "source_ip", "severity", "message"))
    return f"""WITH r AS (SELECT event_id, event_id // 1000 AS seq, trim(replace(replace(x, '%U', CAST(user_id AS VARCHAR)), '%A', CAST(event_id // {len(LINES)} % 5 AS VARCHAR))) AS raw FROM events JOIN (VALUES {lines}) t(k, x) ON event_id % {len(LINES)} = k),
j AS (SELECT *, CASE WHEN json_valid(raw) AND left(raw, 1) = '{{' THEN raw::JSON END AS js FROM r),
f AS (SELECT *, {fields}, CASE WHEN raw = '' THEN 'rejected' WHEN js IS NOT NULL THEN 'structured' WHEN left(raw, 1) IN ('{{', '[') THEN 'malformed_json' ELSE 'text' END AS parse_status FROM j),
t AS (SELECT *, CASE WHEN js IS NULL THEN raw ELSE coalesce(f_message, array_to_string(list_transform(json_keys(js), lambda k: json_extract_string(js, '$.' || k)), ' ')) END AS text FROM f),
w AS (SELECT * FROM (VALUES {words}) t(rank, kind, grp, word)), need AS (SELECT rank, kind, count(DISTINCT grp) AS n FROM w GROUP BY ALL),
hit AS (SELECT event_id, rank, kind, count(DISTINCT grp) AS n FROM t JOIN w ON contains(lower(text), word) GROUP BY ALL),
c AS (SELECT event_id, arg_min(kind, rank) AS kind FROM hit JOIN need USING (rank, kind, n) GROUP BY 1),
p AS (SELECT t.*, coalesce(kind, 'unknown security event') AS event_type, coalesce(lower(coalesce(f_user, f_account)) IN ('root', 'administrator', 'admin'), false) OR regexp_matches(lower(text), '\\b(root|administrator)\\b') AS privileged FROM t LEFT JOIN c USING (event_id)),
lv AS (SELECT * FROM (VALUES ('arp spoofing', 'high', 'high'), ('log tampering', 'high', 'high'), ('privileged group addition', 'high', 'high'), ('account creation', 'medium', 'medium'), ('port scan', 'medium', 'medium'), ('ids alert', 'medium', 'medium'), ('firewall block', 'low', 'low'), ('network anomaly', 'low', 'low'), ('authentication failure', 'high', 'medium'), ('successful login', 'high', 'low')) t(event_type, high, low)),
bs AS (SELECT * FROM (VALUES ('critical', 90), ('high', 70), ('medium', 45), ('low', 20), ('unknown', 0)) t(severity, base)),
s AS (SELECT p.*, CASE WHEN lower(f_severity) IN (SELECT severity FROM bs) THEN lower(f_severity) WHEN privileged THEN coalesce(high, 'unknown') ELSE coalesce(low, 'unknown') END AS severity FROM p LEFT JOIN lv USING (event_type)),
soc AS (SELECT s.*, CAST(least(100, base + CASE WHEN privileged THEN 10 ELSE 0 END + CASE WHEN event_type = 'authentication failure' AND regexp_matches(lower(text), 'repeated|multiple|brute') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'critical') THEN 5 ELSE 0 END) AS INTEGER) AS severity_score,
 coalesce(f_src_ip, f_source_ip, f_ip, f_remote_addr, f_src_host, nullif(regexp_extract(text, '\\bfrom [\\[(]?([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)\\b', 1), '')) AS source,
 list_sort(list_distinct(CASE WHEN coalesce(f_src_ip, f_source_ip, f_ip, f_remote_addr) IS NOT NULL THEN list_filter([f_src_ip, f_source_ip, f_ip, f_remote_addr], lambda x: x IS NOT NULL) ELSE regexp_extract_all(text, '\\b[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+\\b') END)) AS indicators,
 CASE WHEN js IS NOT NULL THEN concat_ws(';', {shown}) ELSE concat_ws(';', CASE WHEN regexp_matches(lower(text), 'root|administrator') THEN 'privileged_account=root/administrator' END,
 CASE event_type WHEN 'authentication failure' THEN 'event_signal=failed password / invalid user' WHEN 'ids alert' THEN 'event_signal=suricata / alert keyword' END) END AS evidence FROM s JOIN bs USING (severity))
{rest}"""


@query("mixed_triage", _sql("""SELECT event_id, parse_status, event_type, privileged, severity, severity_score, source, array_to_string(indicators, ',') AS indicators, evidence,
CAST(2 + CASE WHEN event_type IN ('authentication failure', 'successful login', 'ids alert', 'log tampering', 'privileged group addition', 'account creation', 'port scan') THEN 2 ELSE 0 END + CASE WHEN severity IN ('high', 'critical') THEN 1 ELSE 0 END AS BIGINT) AS n_actions FROM soc"""))
def mixed_triage(spark, sf_dir):
    rows = soc.evidence(F.col("text"), F.col("fields"), F.col("event_type"))
    said = F.array_join(F.transform(rows, lambda x: F.concat_ws("=", x["field"], x["value"])), ";")
    own = mixed(spark, sf_dir).withColumns({"evidence": said, "n_actions": F.size(soc.recommended_actions(F.col("event_type"), F.col("severity"))).cast("long"), "indicators": F.array_join("indicators", ",")})
    return own.select("event_id", "parse_status", "event_type", "privileged", "severity", "severity_score", "source", "indicators", "evidence", "n_actions")


FOUND = """, g AS (SELECT seq, source, list(event_id ORDER BY event_id) FILTER (event_type = 'authentication failure') AS fails, list(event_id ORDER BY event_id) FILTER (event_type = 'successful login') AS logins, list(event_id ORDER BY event_id) FILTER (event_type = 'arp spoofing') AS arps,
 coalesce(bool_or(privileged) FILTER (event_type = 'authentication failure'), false) AS priv FROM soc WHERE source IS NOT NULL GROUP BY ALL),
h AS (SELECT *, list_min(list_filter(logins, lambda x: x > fails[1])) AS login FROM g),
found AS (SELECT CAST(seq AS VARCHAR) AS sequence_id, source, 'brute_force' AS pattern, CASE WHEN priv THEN 'critical' ELSE 'high' END AS severity, fails AS own FROM h WHERE len(fails) >= 3
 UNION ALL SELECT CAST(seq AS VARCHAR), source, 'auth_failure_then_success', 'critical', list_append(list_filter(fails, lambda x: x < login), login) FROM h WHERE login IS NOT NULL
 UNION ALL SELECT CAST(seq AS VARCHAR), source, 'arp_spoof_burst', 'critical', arps FROM h WHERE len(arps) >= 3)
"""


@query("mixed_findings", _sql(FOUND + "SELECT sequence_id, source, pattern, severity, CAST(len(own) AS BIGINT) AS event_count, array_to_string(own, ',') AS evidence FROM found"))
def mixed_findings(spark, sf_dir):
    return sequence.findings(mixed(spark, sf_dir)).select("sequence_id", "source", "pattern", "severity", "event_count", F.array_join("evidence", ",").alias("evidence"))


@query("mixed_summary", _sql(FOUND + "SELECT sequence_id, source, pattern, severity, CAST(len(own) AS BIGINT) AS event_count, own[1] AS first_idx, own[-1] AS last_idx FROM found"))
def mixed_summary(spark, sf_dir):
    return sequence.summary(correlated(spark, sf_dir)).drop("block")


@query("mixed_evidence", _sql(FOUND + "SELECT sequence_id, source, pattern, CAST(unnest(range(len(own))) AS BIGINT) AS place, unnest(own) AS idx FROM found"))
def mixed_evidence(spark, sf_dir):
    own = correlated(spark, sf_dir)
    return sequence.evidence(own, sequence.summary(own))


@query("mixed_rollup", _sql(FOUND + """, k AS (SELECT sequence_id, count(*) AS n FROM found GROUP BY 1)
SELECT CAST(seq AS VARCHAR) AS sequence_id, count(*) AS event_count, count(*) FILTER (source IS NULL) AS uncorrelated_count, count(*) FILTER (parse_status = 'malformed_json') AS malformed_count, CAST(any_value(coalesce(n, 0)) AS BIGINT) AS finding_count
FROM soc LEFT JOIN k ON sequence_id = CAST(seq AS VARCHAR) GROUP BY seq"""))
def mixed_rollup(spark, sf_dir):
    own = correlated(spark, sf_dir)
    return sequence.roll_up(own, sequence.summary(own)).select("sequence_id", "event_count", "uncorrelated_count", "malformed_count", "finding_count")
