"""Queries over vendor records, graphs, inventories, controls and observables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..content.response import ALIASES, MITIGATIONS
from ..functions.observables import sysmon_hashes
from ..functions.text import parent_name, sanitised_target, shortened
from ..operators import controls, detection, graph, intake, intel, inventory, ocsf, response, retrieval, soc
from ..sources import vendors
from .adapter import LOGS_SQL, logs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: A record of each kind, by event_id % 13; %U is the user. Below it what the parser makes of it:
#: vendor, source type, activity, id of the record, message, parse status, user, source address, number of notes.
STAMP = "2026-08-14T09:31:44Z"
RECORDS = [
    (
        '{"Channel":"Microsoft-Windows-Sysmon/Operational","EventID":1,"@timestamp":"%T","Image":"run%U.exe","ParentImage":"explorer.exe","CommandLine":"run%U -q","User":"u%U","Hashes":"MD5=0123456789abcdef0123456789abcdef"}',
        ("sysmon", "endpoint", "process creation", "1", "process creation image=run%U.exe parent=explorer.exe cmd=run%U -q", "structured", "u%U", None, 0),
    ),
    ('{"type":"EXECVE","@timestamp":"%T","exe":"/bin/sh","auid":"%U","a0":"sh","a2":"u%U","a1":"-c"}', ("auditd", "endpoint", "execve", "EXECVE", "auditd EXECVE exe=/bin/sh cmd=sh -c u%U", "structured", "%U", None, 0)),
    (
        '{"_path":"dns","uid":"C%U","ts":"%T","id.orig_h":"10.0.0.1","id.orig_p":5353,"id.resp_h":"198.51.100.9","id.resp_p":53,"proto":"udp","query":"q%U.example"}',
        ("zeek", "network", "dns", "C%U", "zeek dns 10.0.0.1:5353 -> 198.51.100.9:53 proto=udp query=q%U.example", "structured", None, "10.0.0.1", 0),
    ),
    (
        '{"event_type":"alert","timestamp":"%T","src_ip":"10.0.0.2","src_port":4000,"dest_ip":"198.51.100.9","dest_port":443,"alert":{"signature_id":2001,"signature":"ET SCAN %U","severity":2}}',
        ("suricata", "network", "alert", "2001", "suricata alert 10.0.0.2:4000 -> 198.51.100.9:443 signature=ET SCAN %U severity=2", "structured", None, "10.0.0.2", 0),
    ),
    (
        '{"eventSource":"iam.amazonaws.com","eventName":"CreateUser","eventID":"e%U","eventTime":"%T","userIdentity":{"userName":"u%U","arn":"arn:aws:iam::1:user/u%U"},"sourceIPAddress":"198.51.100.7"}',
        ("aws-cloudtrail", "cloud", "CreateUser", "e%U", "cloudtrail CreateUser service=iam.amazonaws.com principal=u%U src=198.51.100.7 outcome=success", "structured", "u%U", "198.51.100.7", 0),
    ),
    (
        '{"operationName":"Create VM","subscriptionId":"s1","resourceId":"/vm/%U","correlationId":"c%U","eventTimestamp":"%T","caller":"u%U@corp.example","callerIpAddress":"198.51.100.8","status":"Succeeded"}',
        ("azure-activity", "cloud", "Create VM", "c%U", "azure-activity Create VM caller=u%U@corp.example src=198.51.100.8 status=Succeeded resource=/vm/%U", "structured", None, "198.51.100.8", 0),
    ),
    (
        '{"id":"i%U","createdDateTime":"%T","userPrincipalName":"u%U@corp.example","userDisplayName":"User %U","appDisplayName":"Portal","ipAddress":"198.51.100.9","location":{"countryOrRegion":"DE"},"authenticationRequirement":"multiFactorAuthentication","riskLevelDuringSignIn":"none","status":{"errorCode":50126,"failureReason":"Invalid password"}}',
        ("entra-id", "identity", "sign-in", "i%U", "entra sign-in upn=u%U@corp.example app=Portal src=198.51.100.9 country=DE mfa=multiFactorAuthentication risk=none outcome=failure (50126) reason=Invalid password", "structured", "User %U", "198.51.100.9", 0),
    ),
    (
        '{"uuid":"k%U","eventType":"user.session.start","published":"%T","actor":{"alternateId":"u%U@corp.example","displayName":"User %U"},"client":{"ipAddress":"198.51.100.4"},"outcome":{"result":"FAILURE"}}',
        ("okta", "identity", "user.session.start", "k%U", "okta user.session.start actor=u%U@corp.example src=198.51.100.4 outcome=FAILURE", "structured", "User %U", "198.51.100.4", 0),
    ),
    (
        '{"NetworkMessageId":"n%U","Timestamp":"%T","SenderFromAddress":"a@x.example","RecipientEmailAddress":"u%U@corp.example","Subject":"Hi %U","DeliveryAction":"Blocked","SenderIPv4":"198.51.100.3"}',
        ("defender-o365", "email", "email delivery", "n%U", "defender-o365 email sender=a@x.example recipients=1 subject=Hi %U delivery=Blocked", "structured", None, "198.51.100.3", 0),
    ),
    (
        '{"message_id":"m%U","event_timestamp":"%T","sender_address":"b@x.example","recipient_addresses":["u%U@corp.example","z@corp.example"],"subject":"Re %U","status":"DELIVERED","sender_ip":"198.51.100.2"}',
        ("google-workspace", "email", "email delivery", "m%U", "workspace email sender=b@x.example recipients=2 subject=Re %U status=DELIVERED", "structured", None, "198.51.100.2", 0),
    ),
    # two vendors claim it
    (
        '{"event_type":"dns","src_ip":"10.0.0.3","dest_ip":"10.0.0.4","eventType":"a.b","actor":{"id":"%U"},"outcome":{"result":"x"}}',
        ("unrecognized", "unknown", None, None, '{"event_type":"dns","src_ip":"10.0.0.3","dest_ip":"10.0.0.4","eventType":"a.b","actor":{"id":"%U"},"outcome":{"result":"x"}}', "partial", None, None, 1),
    ),
    # neither a time nor a known number
    ('{"Channel":"Sysmon","EventID":999,"User":"u%U"}', ("sysmon", "endpoint", "sysmon event 999", "999", "sysmon event 999", "partial", "u%U", None, 2)),
    # cut off
    ('{"a": [1, %U', ("unrecognized", "unknown", None, None, '{"a": [1, %U', "partial", None, None, 1)),
]
VENDOR_COLUMNS = ["vendor", "source_type", "activity", "record_id", "message", "parse_status", "user", "src_ip", "n_notes"]


def _said_sql(value, kind: str = "VARCHAR") -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    return str(value) if isinstance(value, int) else f"replace('{value}', '%U', CAST(user_id AS VARCHAR))"


def _vendor_sql() -> str:
    columns = []
    for k, name in enumerate(VENDOR_COLUMNS):
        whens = " ".join(f"WHEN {i} THEN {_said_sql(own[k])}" for i, (_, own) in enumerate(RECORDS))
        columns.append(f"{'CAST(' if name == 'n_notes' else ''}CASE event_id % {len(RECORDS)} {whens} END{' AS INTEGER)' if name == 'n_notes' else ''} AS \"{name}\"")
    timed = f"CASE WHEN event_id % {len(RECORDS)} < 10 THEN epoch(TIMESTAMP '2026-08-14 09:31:44')::DOUBLE END AS epoch"
    return f"SELECT event_id, {', '.join(columns)}, {timed} FROM events"


def vendor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.element_at(F.array(*[F.lit(r.replace("%T", STAMP)) for r, _ in RECORDS]), (F.col("event_id") % len(RECORDS) + 1).cast("int"))
    return e.select("event_id", F.replace(raw, F.lit("%U"), F.col("user_id").cast("string")).alias("raw"))


@query("vendor_all", _vendor_sql())
def vendor_all(spark, sf_dir):
    """Every event as a record of one of the ten vendors, of two, of none or cut off."""
    e = vendors.normalised(vendor_records(spark, sf_dir))
    f = lambda path: F.col(f"event.{path}")
    return e.select("event_id", f("vendor"), f("source_type"), f("activity"), f("vendor_event_id").alias("record_id"), f("message"), f("parse_status"), f("actor.user_name").alias("user"), f("src_endpoint.ip").alias("src_ip"), F.size(f("notes")).alias("n_notes"), f("timestamp").alias("epoch"))


@query("vendor_ocsf", f"""SELECT vendor, CAST(class_uid AS INTEGER) AS class_uid, count(*) AS n FROM (SELECT CASE event_id % {len(RECORDS)} {' '.join(f"WHEN {i} THEN '{own[0]}'" for i, (_, own) in enumerate(RECORDS))} END AS vendor,
CASE event_id % {len(RECORDS)} WHEN 0 THEN 1007 WHEN 1 THEN 1007 WHEN 2 THEN 4003 WHEN 3 THEN 2004 WHEN 4 THEN 6003 WHEN 5 THEN 6003 WHEN 6 THEN 3002 WHEN 7 THEN 3002 WHEN 8 THEN 4009 WHEN 9 THEN 4009 ELSE 0 END AS class_uid FROM events) GROUP BY ALL""")
def vendor_ocsf(spark, sf_dir):
    e = vendors.normalised(vendor_records(spark, sf_dir)).withColumn("o", ocsf.of_activity(F.col("event.source_type"), F.col("event.activity")))
    return e.groupBy("event.vendor", "o.class_uid").agg(F.count(F.lit(1)).alias("n"))


# files of 40 roots, a kind by each order
FILES = [
    (".gitignore", "'.env' || chr(10) || 'data/'", lambda: F.lit(".env\ndata/")),
    (".env.example", "'KEY='", lambda: F.lit("KEY=")),
    ("uv.lock", "'x'", lambda: F.lit("x")),
    ("security/sbom/a.json", "''", lambda: F.lit("")),
    (".github/workflows/ci.yml", "'ruff mypy bandit' || CASE WHEN o_custkey % 2 = 0 THEN ' pytest' ELSE '' END", lambda: F.when(F.col("o_custkey") % 2 == 0, "ruff mypy bandit pytest").otherwise("ruff mypy bandit")),
    ("tests/security/test_%.py", "''", lambda: F.lit("")),
    ("SECURITY.md", "'x'", lambda: F.lit("x")),
]
FILES_SQL = f"""f AS (SELECT DISTINCT 'r' || (o_custkey % 400) AS root, replace(CASE o_orderkey % 7 {' '.join(f"WHEN {i} THEN '{p}'" for i, (p, _, _) in enumerate(FILES))} END, '%', CAST(o_orderkey // 7 % 6 AS VARCHAR)) AS path,
CASE o_orderkey % 7 {' '.join(f"WHEN {i} THEN {t}" for i, (_, t, _) in enumerate(FILES))} END AS text FROM orders)"""


@query("control_checks", f"""WITH {FILES_SQL}, g AS (SELECT root, bool_or(path = '.gitignore') AS ignored, bool_or(path = '.env.example') AS example, bool_or(path = 'uv.lock') AS lock, bool_or(path LIKE 'security/sbom/%') AS sbom, bool_or(path LIKE '%ci.yml' AND contains(text, 'ruff')) AS ci,
bool_or(path LIKE '%ci.yml' AND contains(text, 'pytest')) AS tested, count(*) FILTER (path LIKE 'tests/security/%') AS n_tests FROM f GROUP BY 1)
SELECT root, c.control_id, CASE WHEN CASE c.control_id WHEN 'secrets' THEN ignored AND example WHEN 'lab-data' THEN ignored WHEN 'lock' THEN lock WHEN 'bill-of-materials' THEN sbom WHEN 'gates' THEN ci AND tested WHEN 'security-tests' THEN n_tests >= 5 ELSE false END THEN 'pass' ELSE 'fail' END AS status
FROM g, (VALUES ('secrets'), ('lab-data'), ('lock'), ('bill-of-materials'), ('gates'), ('secret-scan'), ('security-tests'), ('documents'), ('upload-cap')) c(control_id)""")
def control_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 7
    path = F.element_at(F.array(*[F.lit(p) for p, _, _ in FILES]), (kind + 1).cast("int"))
    text = F.coalesce(*[F.when(kind == i, t()) for i, (_, _, t) in enumerate(FILES)])
    files = o.select(F.concat(F.lit("r"), (F.col("o_custkey") % 400).cast("string")).alias("root"), F.replace(path, F.lit("%"), (F.floor(F.col("o_orderkey") / 7) % 6).cast("string")).alias("path"), text.alias("text")).distinct()
    return controls.checked(files.withColumn("size", F.length("text"))).select("root", "control_id", "status")


@query("path_confined", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a/b' || p_partkey WHEN 1 THEN NULL WHEN 2 THEN 'b' || p_partkey WHEN 3 THEN NULL WHEN 4 THEN '' ELSE NULL END AS path FROM part""")
def path_confined(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 6
    raw = F.when(kind == 0, F.concat(F.lit("a/./b"), k)).when(kind == 1, F.concat(F.lit("a/../../b"), k)).when(kind == 2, F.concat(F.lit("a/../b"), k, F.lit("/"))).when(kind == 3, F.concat(F.lit("/etc/"), k)).when(kind == 4, F.lit("a/..")).otherwise(F.repeat(F.lit("x"), 1100))
    return table(spark, sf_dir, "part").select("p_partkey", controls.confined(raw).alias("path"))


@query("input_validators", r"""WITH r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN ' Host-' || s_suppkey || '.Example ' WHEN 1 THEN 'bad host ' || s_suppkey WHEN 2 THEN 'svc_' || s_suppkey WHEN 3 THEN md5('' || s_suppkey) ELSE '-x' || s_suppkey END AS v FROM supplier), l AS (SELECT *, lower(trim(v)) AS x FROM r)
SELECT s_suppkey, CASE WHEN regexp_full_match(x, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*') THEN x END AS host, CASE WHEN regexp_full_match(x, '[a-z_][a-z0-9._-]{0,31}') THEN x END AS account,
CASE WHEN regexp_full_match(x, '[0-9a-f]{32}') OR regexp_full_match(x, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*') THEN x END AS indicator FROM l""")
def input_validators(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 5
    v = F.when(kind == 0, F.concat(F.lit(" Host-"), k, F.lit(".Example "))).when(kind == 1, F.concat(F.lit("bad host "), k)).when(kind == 2, F.concat(F.lit("svc_"), k)).when(kind == 3, F.md5(k.cast("binary"))).otherwise(F.concat(F.lit("-x"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", controls.host(v).alias("host"), controls.account(v).alias("account"), controls.indicator(v).alias("indicator"))


@query("sysmon_digests", """SELECT p_partkey, md5('' || p_partkey) || ',' || sha256('' || p_partkey) AS digests FROM part""")
def sysmon_digests(spark, sf_dir):
    k = F.col("p_partkey").cast("string").cast("binary")
    text = F.concat(F.lit("MD5="), F.md5(k), F.lit(",SHA256="), F.sha2(k, 256), F.lit(",OTHER=zz"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sysmon_hashes(text), ",").alias("digests"))


@query("sanitised_targets", r"""SELECT p_partkey, substr(regexp_replace(p_name || ' @ ' || p_brand, '[^A-Za-z0-9._:@-]', '-', 'g'), 1, 120) AS target, 'dir' || p_size AS folder FROM part""")
def sanitised_targets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sanitised_target(F.concat_ws(" @ ", "p_name", "p_brand")).alias("target"), parent_name(F.concat(F.lit("a/dir"), F.col("p_size").cast("string"), F.lit("/x.md"))).alias("folder"))


@query("shortened_names", """SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_brand) <= 16 THEN p_name || ' ' || p_brand ELSE rtrim(substr(p_name || ' ' || p_brand, 1, 15)) || '…' END AS short FROM part""")
def shortened_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", shortened(F.concat(F.lit(" "), F.col("p_name"), F.lit(" \t "), F.col("p_brand")), 16).alias("short"))


BEHAVIORS_SQL = """SELECT 'B' || p_partkey AS behavior_id, CASE WHEN p_size % 20 >= 15 OR p_partkey % 7 >= 15 THEN 'stale_anchor' WHEN p_size * 10 > 250 THEN 'review_due' ELSE 'active' END AS status FROM part"""


@query("behavior_status", BEHAVIORS_SQL)
def behavior_status(spark, sf_dir):
    """Behavioural records against a corpus in which techniques 15 and 16 are revoked and those beyond aren't there."""
    size, as_of = F.col("p_size").cast("int"), F.lit("2026-08-21").cast("date")
    t = lambda n: F.concat(F.lit("T"), n.cast("string"))
    records = table(spark, sf_dir, "part").select(F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("behavior_id"), F.array(t(size % 20), t(F.col("p_partkey") % 7)).alias("techniques"), F.date_sub(as_of, size * 10).alias("last_reviewed"), F.lit(250).alias("review_days"))
    corpus = spark.range(17).select(t(F.col("id")).alias("technique_id"), F.when(F.col("id") < 15, "active").otherwise("revoked").alias("status"))
    return intel.behavior_status(records, corpus, as_of).select("behavior_id", "status")


@query("newest_retrieval", "SELECT CAST(max(o_orderdate)::DATE AS VARCHAR) AS as_of, count(*) AS n FROM orders")
def newest_retrieval(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("retrieved"))
    return own.agg(F.count(F.lit(1)).alias("n")).select(intel.default_as_of(own, own.limit(0)).cast("string").alias("as_of"), "n")


@query("indicators_distinct", f"WITH {LOGS_SQL} SELECT DISTINCT source AS indicator FROM soc WHERE source IS NOT NULL")
def indicators_distinct(spark, sf_dir):
    return soc.triaged(logs(spark, sf_dir)).select(F.explode("indicators").alias("indicator")).distinct()


def _rules(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    level = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (k % 4 + 1).cast("int"))
    return n.select(F.concat(F.lit("rule"), (k % 12).cast("string")).alias("rule_id"), F.concat(F.lit("Rule "), (k % 12).cast("string")).alias("title"), F.when(F.lit(True), level).alias("level"), F.concat(F.lit("T"), (k % 9).cast("string")).alias("technique_id")).distinct()


RULES_SQL = "r AS (SELECT DISTINCT 'rule' || (n_nationkey % 12) AS rule_id, 'Rule ' || (n_nationkey % 12) AS title, n_nationkey % 4 AS lvl, 'T' || (n_nationkey % 9) AS technique_id FROM nation)"


@query("rules_for_techniques", f"""WITH {RULES_SQL}, s AS (SELECT s_suppkey, s_nationkey % 7 AS pos, 'T' || (s_suppkey % 11) AS technique_id FROM supplier UNION ALL SELECT s_suppkey, 9, 'T' || (s_nationkey % 9) FROM supplier),
m AS (SELECT s_suppkey, rule_id, min(struct_pack(pos := pos, technique_id := technique_id)) AS m FROM s JOIN r USING (technique_id) GROUP BY ALL) SELECT s_suppkey, rule_id, m.pos AS pos, m.technique_id AS technique_id FROM m""")
def rules_for_techniques(spark, sf_dir):
    """Rules that share a technique with a supplier's, once per supplier and rule, by the first technique."""
    s = table(spark, sf_dir, "supplier")
    first = s.select("s_suppkey", (F.col("s_nationkey") % 7).cast("long").alias("pos"), F.concat(F.lit("T"), (F.col("s_suppkey") % 11).cast("string")).alias("technique_id"))
    second = s.select("s_suppkey", F.lit(9).cast("long").alias("pos"), F.concat(F.lit("T"), (F.col("s_nationkey") % 9).cast("string")).alias("technique_id"))
    found = detection.for_techniques(first.unionByName(second), _rules(spark, sf_dir).select("rule_id", "technique_id", "level").withColumn("level", F.lit("high")).distinct())
    return detection.first_per_rule(found.select("s_suppkey", "pos", "technique_id", "rule_id"), "s_suppkey", ["pos", "technique_id"]).select("s_suppkey", "rule_id", "pos", "technique_id")


@query("rules_uncovered", f"""WITH {RULES_SQL}, f AS (SELECT DISTINCT 'rule' || (s_suppkey % 7) AS rule_id FROM supplier) SELECT rule_id, 'no fixture' AS side FROM (SELECT DISTINCT rule_id FROM r WHERE rule_id NOT IN (SELECT rule_id FROM f)) UNION ALL SELECT rule_id, 'no rule' FROM f WHERE rule_id NOT IN (SELECT rule_id FROM r)""")
def rules_uncovered(spark, sf_dir):
    fixtures = table(spark, sf_dir, "supplier").select(F.concat(F.lit("rule"), (F.col("s_suppkey") % 7).cast("string")).alias("rule_id")).distinct()
    without, orphans = detection.uncovered(_rules(spark, sf_dir), fixtures)
    return without.withColumn("side", F.lit("no fixture")).unionByName(orphans.withColumn("side", F.lit("no rule")))


@query("coverage_by_technique", f"WITH {RULES_SQL}, c AS (SELECT technique_id, count(DISTINCT rule_id) AS n_rules FROM r GROUP BY 1) SELECT technique_id, n_rules, n_rules / (SELECT max(n_rules) FROM c) AS share FROM c")
def coverage_by_technique(spark, sf_dir):
    return detection.coverage(_rules(spark, sf_dir)).select("technique_id", "n_rules", "share")


@query("table_health", "SELECT 'orders' AS layer, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'none', 0")
def table_health(spark, sf_dir):
    return detection.health({"orders": table(spark, sf_dir, "orders"), "parts": table(spark, sf_dir, "part"), "none": table(spark, sf_dir, "part").filter("false")})


@query("technique_parents", """SELECT DISTINCT 'T' || p_size || '.' || (p_partkey % 5) AS technique_id, 'T' || p_size AS parent_id FROM part WHERE p_partkey % 3 = 0""")
def technique_parents(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_size").cast("string").alias("s"), (F.col("p_partkey") % 5).cast("string").alias("k"))
    own = p.select(F.concat_ws("-", F.lit("sub"), "s", "k").alias("id"), F.concat(F.lit("T"), "s", F.lit("."), "k").alias("external_id")).unionByName(p.select(F.concat(F.lit("top-"), "s").alias("id"), F.concat(F.lit("T"), "s").alias("external_id"))).distinct()
    edges = p.select(F.lit("subtechnique-of").alias("kind"), F.concat_ws("-", F.lit("sub"), "s", "k").alias("source"), F.concat(F.lit("top-"), "s").alias("target")).distinct()
    return graph.parents(edges, own.withColumns({"type": F.lit("attack-pattern"), "name": F.col("external_id")}))


@query("detection_sources", """WITH s AS (SELECT 'T' || (l_partkey % 60) AS technique_id, 'S' || (l_partkey % 60 * 3 + l_linenumber % 3) AS strategy FROM lineitem) SELECT technique_id, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies,
string_agg(DISTINCT 'log' || (CAST(substr(strategy, 2) AS INT) % 5) || ':ch', ',' ORDER BY 'log' || (CAST(substr(strategy, 2) AS INT) % 5) || ':ch') AS log_sources, string_agg(DISTINCT 'C' || (CAST(substr(strategy, 2) AS INT) % 4), ',' ORDER BY 'C' || (CAST(substr(strategy, 2) AS INT) % 4)) AS data_components FROM s GROUP BY 1""")
def detection_sources(spark, sf_dir):
    """Strategies that detect a technique, and the log sources and data components behind their analytics."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("t"), (F.col("l_partkey") % 60 * 3 + F.col("l_linenumber") % 3).alias("s")).distinct()
    text = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    t, s = F.col("t"), F.col("s")
    refs = "array<struct<name:string,channel:string,x_mitre_data_component_ref:string>>"
    empty = {"x_mitre_analytic_refs": F.lit(None).cast("array<string>"), "x_mitre_log_source_references": F.lit(None).cast(refs)}
    strategies = li.select(text("strategy-", s).alias("id"), F.lit("x-mitre-detection-strategy").alias("type"), text("S", s).alias("name"), F.array(text("analytic-", s)).alias("x_mitre_analytic_refs")).distinct().withColumn("x_mitre_log_source_references", empty["x_mitre_log_source_references"])
    source = F.array(F.struct(text("log", s % 5).alias("name"), F.lit("ch").alias("channel"), text("component-", s % 4).alias("x_mitre_data_component_ref"))).cast(refs)
    analytics = li.select(text("analytic-", s).alias("id"), F.lit("x-mitre-analytic").alias("type"), text("A", s).alias("name"), empty["x_mitre_analytic_refs"].alias("x_mitre_analytic_refs"), source.alias("x_mitre_log_source_references")).distinct()
    components = spark.range(4).select(text("component-", F.col("id")).alias("c"), text("C", F.col("id")).alias("name")).select(F.col("c").alias("id"), F.lit("x-mitre-data-component").alias("type"), "name").withColumn("external_id", F.col("name"))
    own = components.unionByName(li.select(text("pattern-", t).alias("id"), F.lit("attack-pattern").alias("type"), text("T", t).alias("name"), text("T", t).alias("external_id")).distinct())
    edges = li.select(F.lit("detects").alias("kind"), text("strategy-", s).alias("source"), text("pattern-", t).alias("target")).distinct()
    out = graph.detections(strategies.unionByName(analytics), own, edges)
    return out.select("technique_id", *[F.array_join(c, ",").alias(c) for c in ("strategies", "log_sources", "data_components")])


@query("ledger_unresolved", "SELECT 'T' || (o_orderkey % 90) AS technique_id, count(*) AS n FROM orders WHERE o_orderkey % 90 >= 70 GROUP BY 1")
def ledger_unresolved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("T"), (F.col("o_orderkey") % 90).cast("string")).alias("technique_id"))
    known = spark.range(70).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("id"))
    return graph.unresolved(o, "technique_id", known, "id").groupBy("technique_id").agg(F.count(F.lit(1)).alias("n"))


@query("keys_repeated", "SELECT l_orderkey, l_suppkey, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def keys_repeated(spark, sf_dir):
    return graph.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("vulnerabilities_remapped", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 500 < 300 THEN 'pkg:npm/p' || (l_partkey % 500) || '@1' ELSE 'ref' || (l_partkey % 500) END AS ref FROM lineitem""")
def vulnerabilities_remapped(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("ref"), (F.col("l_partkey") % 500).cast("string")).alias("ref"))
    k = F.col("id").cast("string")
    components = spark.range(300).select(F.concat(F.lit("ref"), k).alias("ref"), F.concat(F.lit("pkg:npm/p"), k, F.lit("@1")).alias("purl"))
    return inventory.remapped(li, components).select("l_orderkey", "l_linenumber", "ref")


CAPABILITIES = [*MITIGATIONS, *ALIASES, "unheard_of"]
_PRIMARY = {c: ALIASES.get(c, c) for c in CAPABILITIES}


@query("containment_mitigations", f"""WITH c(k, capability, "primary", mitigation_id) AS (VALUES {", ".join(f"({i}, '{c}', '{p}', {chr(39) + MITIGATIONS[p][0] + chr(39) if p in MITIGATIONS else 'NULL'})" for i, (c, p) in enumerate(_PRIMARY.items()))}) SELECT s_suppkey, capability, "primary", mitigation_id FROM supplier JOIN c ON s_suppkey % {len(CAPABILITIES)} = k""")
def containment_mitigations(spark, sf_dir):
    own = F.element_at(F.array(*map(F.lit, CAPABILITIES)), (F.col("s_suppkey") % len(CAPABILITIES) + 1).cast("int"))
    return response.mitigations(table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("capability"))).select("s_suppkey", "capability", "primary", "mitigation_id")


@query("tasks_planned", r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[\n;]+'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-*•]+', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS parts FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(parts, 1) - 1 AS idx, unnest(parts) AS task FROM t), p AS (SELECT *, CASE WHEN regexp_matches(lower(task), 'urgent|asap|critical|deadline|today|now|blocker|blocked|immediately|waiting on|depends on') THEN 0 WHEN regexp_matches(lower(task), 'someday|later|eventually|nice to have|optional|backlog|low priority') THEN 2 ELSE 1 END AS r FROM e)
SELECT conv_id, turn, min(struct_pack(r := r, i := idx)).i::INTEGER AS first_idx, count(*) AS n FROM p GROUP BY ALL""")
def tasks_planned(spark, sf_dir):
    """The first task of each turn once its tasks are ordered by priority."""
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    own = intake.planned(intake.tasks(rows, "k"), "k").withColumn("r", F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2))
    return own.groupBy("k").agg(F.min(F.struct("r", "idx")).alias("m"), F.count(F.lit(1)).alias("n")).select("k.conv_id", "k.turn", F.col("m.idx").alias("first_idx"), "n")


@query("passages", r"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM d),
f AS (SELECT doc_id, len(s) AS n, s, list_transform(s, lambda x: contains(' ' || regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g') || ' ', ' license ')) AS hit FROM s)
SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN list_position(hit, true) > 0 THEN s[list_position(hit, true)] ELSE s[1] END AS whole FROM f""")
def passages(spark, sf_dir):
    """The sentence of each document that holds the word license, else its first."""
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.best_passage(F.lit("license"), F.col("text"), 1_000_000).alias("whole"))
