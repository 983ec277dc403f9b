"""Queries over whole triage, incident reports, text intake, layers, bundles and signed logs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, compliance, detection, intake
from . import pipeline
from .adapter import LOGS_SQL, logs, table
from .queries_data import STOP_SQL
from .queries_more import RULES_SQL, _rules
from .queries_security import AS_OF, TRIAGE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = b"a key of the tests"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    return pipeline.process_events(logs(spark, sf_dir).select("event_id", "raw"), F.lit(AS_OF).cast("date"), _runbooks(spark, sf_dir))


#: Sentences of the corpus that is asked about events.
PHRASES = ["Brute force means many an authentication failure", "Valid accounts give initial access after a successful login", "A local account brings persistence", "Discovery of a network service starts with a port scan", "Look up why a firewall block was set", "An alert of the IDS is checked by hand", "Nothing else"]


def _runbooks(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    phrase = lambda c: F.element_at(F.array(*map(F.lit, PHRASES)), (F.col(c) % len(PHRASES) + 1).cast("int"))
    return s.select(F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(phrase("s_suppkey"), F.lit(". "), phrase("s_nationkey"), F.lit(".")).alias("text"))


def _phrase_sql(column: str) -> str:
    return f"[{', '.join(repr(p) for p in PHRASES)}][{column} % {len(PHRASES)} + 1]"


#: What the rules, the catalogue and the seed say of the event types that occur.
WHOLE_SQL = f"""{LOGS_SQL}, {TRIAGE_SQL},
whole AS (SELECT *, CASE event_type WHEN 'authentication failure' THEN 'ssh_failed_password' WHEN 'successful login' THEN 'ssh_accepted_root_login' WHEN 'account creation' THEN 'linux_local_account_created' WHEN 'port scan' THEN 'network_port_scan' ELSE '' END AS detections,
  CASE WHEN event_type IN ('authentication failure', 'successful login') THEN 'capture-volatile-memory,revoke-account-sessions,reset-account-credentials' WHEN event_type = 'account creation' THEN 'capture-volatile-memory,revoke-account-sessions' ELSE '' END AS plan,
  CASE WHEN event_type IN ('authentication failure', 'successful login') THEN src_ip WHEN event_type = 'account creation' THEN 'affected-host' ELSE '' END AS target,
  CASE WHEN event_type = 'account creation' THEN '' WHEN src_ip = '203.0.113.66' THEN src_ip || '=malicious' ELSE src_ip || '=unknown' END AS verdicts,
  event_type || '/' || split_part(techniques, ',', 1) AS question_id FROM t)"""


@query("event_dossiers", f"WITH {WHOLE_SQL} SELECT event_id, detections, '' AS behaviors, plan, target, verdicts, question_id FROM whole")
def event_dossiers(spark, sf_dir):
    """Verdicts, detections, plan and question of every event."""
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    tables = _tables(spark, sf_dir)
    own = tables["lines"].select(
        "line", join("detections", lambda r: r["rule_id"]).alias("detections"), join("behaviors", lambda r: r["rule_id"]).alias("behaviors"), join("plan", lambda a: a["action_id"]).alias("plan"),
        F.coalesce(F.get("plan", F.lit(0))["target"], F.lit("")).alias("target"), join("verdicts", lambda v: F.concat_ws("=", v["needle"], v["risk"])).alias("verdicts"), "question_id",
    )
    return pipeline.of_events(tables["seen"], own)


#: The questions of the event types that occur.
QUESTIONS = {
    "authentication failure/T1110": "authentication failure credential access Brute Force",
    "successful login/T1078": "successful login initial access Valid Accounts",
    "account creation/T1136.001": "account creation persistence Local Account",
    "port scan/T1046": "port scan discovery Network Service Discovery",
    "firewall block/": "firewall block",
    "ids alert/": "ids alert",
}
QUESTIONS_SQL = f"""chunks AS (SELECT 'run' || s_suppkey AS source, 0 AS index, {_phrase_sql('s_suppkey')} || '. ' || {_phrase_sql('s_nationkey')} || '.' AS text FROM supplier), q AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{t}')" for i, t in QUESTIONS.items())}) t(query_id, query) WHERE query_id IN (SELECT question_id FROM whole)),
asked AS (SELECT * FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}'))) AS term FROM q) WHERE term NOT IN ({STOP_SQL})),
ct AS (SELECT source, index, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS term FROM chunks),
d AS (SELECT term, count(*) AS df FROM ct GROUP BY 1),
w AS (SELECT query_id, term, ln(1 + (SELECT count(*) FROM chunks) / (1.0 + coalesce(df, 0))) AS weight FROM asked LEFT JOIN d USING (term)),
s AS (SELECT query_id, source, index, sum(weight) AS own FROM ct JOIN w USING (term) GROUP BY ALL), total AS (SELECT query_id, sum(weight) AS total FROM w GROUP BY 1),
b AS (SELECT query_id, source, max(own / total) AS score FROM s JOIN total USING (query_id) GROUP BY ALL)"""


@query("event_knowledge", f"WITH {WHOLE_SQL}, {QUESTIONS_SQL} SELECT query_id AS question_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source) AS INTEGER) AS rank, source, round(score, 6) AS score FROM b QUALIFY rank <= 3")
def event_knowledge(spark, sf_dir):
    """The best sources of what is asked about the events."""
    return _tables(spark, sf_dir)["knowledge"].select("question_id", "rank", "source", F.round("score", 6).alias("score"))


@query("incident_reports", rf"""WITH {WHOLE_SQL} SELECT event_id, 17 AS n_sections, replace(CASE WHEN techniques = '' THEN 'No technique is attributed.' ELSE
 CASE event_type WHEN 'authentication failure' THEN '- T1110 credential-access medium' WHEN 'successful login' THEN '- T1078 initial-access medium|- T1021.004 lateral-movement low' WHEN 'account creation' THEN '- T1136.001 persistence medium' ELSE '- T1046 discovery medium' END END, '|', chr(10)) AS techniques,
severity_score || ' / 100' AS score, CASE WHEN verdicts = '' THEN 'None found.' ELSE '- ' || replace(verdicts, '=', ': ') END AS indicators,
CASE WHEN plan = '' THEN 'No plan is proposed on this evidence.' ELSE 'Proposed for a person to decide; nothing was done.' || chr(10) || CASE WHEN contains(plan, 'reset') THEN '- can''t be undone: reset-account-credentials' || chr(10) ELSE '' END
 || '- tier 0: capture-volatile-memory on ' || replace(target, '-', '\-') || ', by human-analyst' || chr(10) || '- tier 2: revoke-account-sessions on ' || replace(target, '-', '\-') || ', by identity-administrator'
 || CASE WHEN contains(plan, 'reset') THEN chr(10) || '- tier 3: reset-account-credentials on ' || replace(target, '-', '\-') || ', by human-identity-administrator' ELSE '' END END AS plan FROM whole""")
def incident_reports(spark, sf_dir):
    """Reports of all events: the number of their sections, and four of them."""
    tables = _tables(spark, sf_dir)
    own = pipeline.line_reports(tables, AS_OF).select("line", F.split("report", r"(?m)^## ").alias("s"))

    def body(title: str):
        return F.trim(F.regexp_replace(F.get(F.filter("s", lambda x: F.startswith(x, F.lit(f"{title}\n"))), F.lit(0)), "^[^\n]*\n\n|\n+$", ""))

    parts = own.select("line", (F.size("s") - 1).alias("n_sections"), body("Techniques").alias("techniques"), body("Severity score").alias("score"), body("Indicators").alias("indicators"), body("Response plan (draft)").alias("plan"))
    return pipeline.of_events(tables["seen"], parts)


@query("event_citations", f"""WITH {WHOLE_SQL}, {QUESTIONS_SQL}, top AS (SELECT query_id, source, own / total AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(own / total, 12) DESC, source) AS rank FROM s JOIN total USING (query_id) QUALIFY rank <= 3)
SELECT query_id AS question_id, CAST(rank AS INTEGER) AS rank, source, round_even(score, 4) AS score FROM top""")
def event_citations(spark, sf_dir):
    """Which passages are cited, once all of a question's quotes are found in their sources."""
    return _tables(spark, sf_dir)["citations"].select("question_id", "rank", "source", "score")


def _some(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def _all_sql(rules: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_some(w)} THEN '{k}' END" for k, w in rules.items()) + "], lambda x: x IS NOT NULL)"


@query("legal_assessments", f"""WITH a AS (SELECT doc_id, {_all_sql(intake.TOPICS)} AS topics, {_all_sql({w: [w] for w in sorted(intake.RISK_TERMS)})} AS flags, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM documents)
SELECT doc_id, CASE WHEN len(topics) = 0 THEN '{intake.UNSORTED}' ELSE topics[1] END AS topic, CAST(greatest(len(topics), 1) AS INTEGER) AS n_topics, CAST(3 * greatest(len(topics), 1) AS INTEGER) AS n_checklist, array_to_string(flags, ',') AS flags, len(flags) > 0 AS escalate,
CASE WHEN length(one) <= 200 THEN one ELSE rtrim(substr(one, 1, 199)) || '…' END AS inquiry, 'unspecified' AS jurisdiction FROM a WHERE one <> ''""")
def legal_assessments(spark, sf_dir):
    own = intake.legal_assessments(table(spark, sf_dir, "documents"))
    return own.select("doc_id", "topic", F.size("topics").alias("n_topics"), F.size("checklist").alias("n_checklist"), F.array_join("flags", ",").alias("flags"), "escalate", "inquiry", "jurisdiction")


OBJECTIVES_SQL = r"list_filter(string_split(regexp_replace(one, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 8)"


@query("proposals", f"""WITH a AS (SELECT doc_id, {_all_sql(intake.SCOPES)} AS areas, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM documents), b AS (SELECT *, {OBJECTIVES_SQL} AS aims FROM a WHERE one <> '')
SELECT doc_id, 'Proposal: ' || CASE WHEN length(one) <= 60 THEN one ELSE rtrim(substr(one, 1, 59)) || '…' END AS title, CASE WHEN len(areas) = 0 THEN '{intake.UNSCOPED}' ELSE array_to_string(areas, ',') END AS areas, CAST(3 * greatest(len(areas), 1) AS INTEGER) AS n_scope,
array_to_string(CASE WHEN len(aims) > 0 THEN aims[1:5] ELSE [one] END, '|') AS objectives FROM b""")
def proposals(spark, sf_dir):
    own = intake.proposals(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.col("proposal_title").alias("title"), F.array_join("areas", ",").alias("areas"), F.size("scope").alias("n_scope"), F.array_join("objectives", "|").alias("objectives"))


@query("portfolio_drafts", f"""WITH a AS (SELECT doc_id, source || ' ' || doc_id AS name, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM documents), b AS (SELECT *, {OBJECTIVES_SQL} AS aims, list_filter(string_split(regexp_replace(one, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1] AS s FROM a WHERE one <> ''),
c AS (SELECT *, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 239)) || '…' END AS summary FROM b)
SELECT doc_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS draft_file, md5('# ' || name || replace('##Overview#', '#', chr(10) || chr(10)) || '') AS head, md5(summary) AS summary, CAST(len(CASE WHEN len(aims) > 0 THEN aims[1:4] ELSE [one] END) AS INTEGER) AS n_aims FROM c""")
def portfolio_drafts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("name", F.concat_ws(" ", "source", F.col("doc_id").cast("string")))
    own = intake.portfolio(d)
    head = F.concat(F.regexp_extract("draft", "^[^\n]*", 0), F.lit("\n\n\n\nOverview\n\n"))
    aims = F.size(F.split(F.regexp_extract("draft", "(?s)## Aims\n\n(.*)\n\n## Results", 1), "\n"))
    return own.select("doc_id", "draft_file", F.md5(head.cast("binary")).alias("head"), F.md5(F.col("draft_summary").cast("binary")).alias("summary"), aims.alias("n_aims"))


@query("navigator_layer", f"WITH {RULES_SQL}, c AS (SELECT technique_id, count(DISTINCT rule_id) AS n, string_agg(DISTINCT title, '; ' ORDER BY title) AS titles FROM r GROUP BY 1) SELECT technique_id AS \"techniqueID\", n AS score, 'Detected by: ' || titles || ' - name of ' || technique_id AS comment, (SELECT max(n) FROM c) AS \"maxValue\" FROM c")
def navigator_layer(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    corpus = rules.select("technique_id", F.concat(F.lit("name of "), "technique_id").alias("name"), F.lit("active").alias("status")).distinct()
    layer = detection.navigator_layer(rules, corpus, "coverage", "19")
    parsed = layer.select(F.from_json("layer", "gradient struct<maxValue: long>, techniques array<struct<techniqueID: string, score: long, comment: string>>").alias("l"))
    return parsed.select(F.explode("l.techniques").alias("t"), F.col("l.gradient.maxValue").alias("maxValue")).select("t.*", "maxValue")


@query("compliance_bundle", """WITH r AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'error' WHEN 3 THEN 'attested' ELSE 'manual' END AS status, n_regionkey AS g FROM nation),
p AS (SELECT count(*) FILTER (status = 'pass') AS passing, count(*) AS automated_total FROM r WHERE status IN ('pass', 'fail', 'error'))
SELECT CAST(round_even(100.0 * passing / automated_total, 0) AS BIGINT) AS score, passing, automated_total, 'c' || lpad(CAST(k AS VARCHAR), 2, '0') AS control, status, (SELECT CAST(count(DISTINCT g) AS INTEGER) FROM r) AS n_frameworks FROM r, p""")
def compliance_bundle(spark, sf_dir):
    """The auditor's bundle over the nations as controls, read back."""
    n = table(spark, sf_dir, "nation")
    status = F.element_at(F.array(*map(F.lit, ("pass", "fail", "error", "attested", "manual"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    results = n.select(F.concat(F.lit("c"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("control_id"), F.col("n_name").alias("title"), F.lit("lab").alias("category"), F.lit("low").alias("severity"), status.alias("status"), F.lit(None).cast("string").alias("detail"), F.array(F.concat(F.lit("F"), F.col("n_regionkey").cast("string"))).alias("frameworks"))
    schema = "score long, passing long, automated_total long, controls array<struct<id: string, status: string>>, framework_rollups array<struct<framework: string>>"
    own = compliance.bundle(results, AS_OF).select(F.from_json("bundle", schema).alias("b"))
    each = own.select("b.score", "b.passing", "b.automated_total", F.explode("b.controls").alias("c"), F.size("b.framework_rollups").alias("n_frameworks"))
    return each.select("score", "passing", "automated_total", F.col("c.id").alias("control"), "c.status", "n_frameworks")


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in KEY.ljust(64, b"\0")).hex()


@query("audit_signatures", f"SELECT o_orderkey, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(o_orderkey || '|' || o_orderstatus)))) AS signature FROM orders")
def audit_signatures(spark, sf_dir):
    """HMAC-SHA256 of every order's key and status, as of a chain's head."""
    return table(spark, sf_dir, "orders").select("o_orderkey", audit.head_signature(KEY, "o_orderkey", "o_orderstatus").alias("signature"))


@query("audit_segments", """WITH RECURSIVE i AS (SELECT o_orderkey AS seq, row_number() OVER (ORDER BY o_orderkey) AS r, sum(o_custkey % 900 + 100) OVER (ORDER BY o_orderkey) AS upto FROM orders),
g AS (SELECT CAST(0 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS r, CAST(0 AS HUGEINT) AS before UNION ALL SELECT g.segment + 1, n.r + 1, n.upto FROM g, LATERAL (SELECT min(i.r) AS r, min(i.upto) AS upto FROM i WHERE i.upto >= g.before + 1000000) n WHERE n.r < (SELECT count(*) FROM i)),
s AS (SELECT seq, segment, sha256(CAST(seq AS VARCHAR)) AS h FROM i ASOF JOIN g ON i.r >= g.r), c AS (SELECT max(segment) - 2 AS oldest FROM s)
SELECT segment, count(*) AS entries, min(seq) AS first_seq, (SELECT max(seq) FROM s, c WHERE segment < oldest) AS cut_seq, (SELECT arg_max(h, seq) FROM s, c WHERE segment < oldest) AS cut_hash FROM s, c WHERE segment >= oldest GROUP BY 1""")
def audit_segments(spark, sf_dir):
    """Orders as log entries: the segments that are kept, and the checkpoint that is left of those that go."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 900 + 100).alias("size"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("entry_hash"))
    kept, checkpoint = audit.retained(audit.rotated(entries, 1_000_000), 2)
    own = kept.groupBy("segment").agg(F.count(F.lit(1)).alias("entries"), F.min("seq").alias("first_seq"))
    return own.crossJoin(F.broadcast(checkpoint.select(F.col("seq").alias("cut_seq"), F.col("entry_hash").alias("cut_hash"))))  # one row beside
