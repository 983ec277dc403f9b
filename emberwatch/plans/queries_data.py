"""Queries over documents, pages, vectors, inventories, evidence and ordered logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..functions.observables import DOMAIN, IPV4, URL, found, observables
from ..functions.text import slug
from ..functions.timeparse import epoch
from ..functions.vector import letter_histogram
from ..operators import audit, compliance, graph, intake, inventory, postings, retrieval, vulnerability
from .adapter import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("observables_extract", r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'), lambda q: list_max(list_transform(string_split(q, '.'), lambda p: p::INT)) <= 255)) AS BIGINT) AS n_ipv4,
CAST(len(regexp_extract_all(text, '(?i)\b(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})\b')) AS BIGINT) AS n_hash FROM documents""")
def observables_extract(spark, sf_dir):
    from ..functions.net import is_dotted_quad
    from ..functions.observables import HASH

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.filter(found(F.col("text"), IPV4), is_dotted_quad)).cast("long").alias("n_ipv4"), F.size(found(F.col("text"), HASH)).cast("long").alias("n_hash"))


@query("observables_assembled", r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?i)\bhttps?://[^\s"''<>]+') AS urls FROM documents),
e AS (SELECT doc_id, urls || regexp_extract_all(text, '(?i)\b(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})\b') || list_filter(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'), lambda q: list_max(list_transform(string_split(q, '.'), lambda p: p::INT)) <= 255)
|| list_filter(regexp_extract_all(regexp_replace(text, '(?i)\bhttps?://[^\s"''<>]+', ' ', 'g'), '(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b'), lambda d: len(list_filter(urls, lambda x: contains(lower(x), lower(d)))) = 0) AS every FROM u)
SELECT doc_id, array_to_string(list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y)), lower(x)) = i)[1:64], ' ') AS observables FROM e""")
def observables_assembled(spark, sf_dir):
    """All observables of each document in order. The SQL leaves out addresses of version 6, of which no table has one."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(observables(F.col("text")), " ").alias("observables"))


@query("url_domain_rollup", r"""SELECT regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1) AS domain, count(*) AS n, count(DISTINCT url) AS urls FROM pages GROUP BY 1""")
def url_domain_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    own = p.select(F.regexp_extract("url", r"(?i)^https?://([^/:?#]+)", 1).alias("domain"), "url")
    return own.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


@query("url_observables", r"""SELECT page_id, len(regexp_extract_all(url, '(?i)\bhttps?://[^\s"''<>]+')) > 0 AS has_url FROM pages""")
def url_observables(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.size(found(F.col("url"), URL)) > 0).alias("has_url"))


@query("domain_extract", r"""SELECT page_id, array_to_string(regexp_extract_all(url, '(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b'), ' ') AS domains FROM pages""")
def domain_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found(F.col("url"), DOMAIN), " ").alias("domains"))


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")


CHUNKS_SQL = r"""c0 AS (SELECT CAST(doc_id AS VARCHAR) AS source, CAST(i AS INTEGER) AS index, substr(text, i * 700 + 1, 800) AS piece, i * 700 AS pos FROM documents, unnest(range(0, (length(text) + 699) // 700)) t(i)),
chunks AS (SELECT source, index, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS text, CAST(pos + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS INTEGER) AS char_start FROM c0 WHERE regexp_replace(piece, '\s+', '', 'g') <> '')"""


@query("rag_chunks", f"WITH {CHUNKS_SQL} SELECT source, index, md5(text) AS text_md5, char_start FROM chunks")
def rag_chunks(spark, sf_dir):
    return retrieval.chunks(_docs(spark, sf_dir)).select("source", "index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "char_start")


#: Queries of the retrieval tests; words of the invented languages and of license lines.
ASKED = [(1, "the license and the apache version"), (2, "thing thatable released under"), (3, "eaument leaux pour chreau"), (4, "schung keit einheit und")]
STOP_SQL = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)
IDF_SQL = f"""{CHUNKS_SQL}, q AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in ASKED)}) t(query_id, query)),
qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}'))) AS term FROM q), asked AS (SELECT * FROM qt WHERE term NOT IN ({STOP_SQL})),
ct AS (SELECT source, index, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS term FROM chunks),
d AS (SELECT term, count(*) AS df FROM ct GROUP BY 1),
w AS (SELECT query_id, term, ln(1 + (SELECT count(*) FROM chunks) / (1.0 + coalesce(df, 0))) AS weight FROM asked LEFT JOIN d USING (term))"""


def _asked(spark) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


@query("rag_idf", f"WITH {IDF_SQL} SELECT query_id, term, round(weight, 6) AS weight FROM w")
def rag_idf(spark, sf_dir):
    weights = retrieval.term_weights(retrieval.chunks(_docs(spark, sf_dir)), _asked(spark))
    return weights.select("query_id", "term", F.round("weight", 6).alias("weight"))


RETRIEVED_SQL = f"""WITH {IDF_SQL}, s AS (SELECT query_id, source, index, sum(weight) AS own FROM ct JOIN w USING (term) GROUP BY ALL), t AS (SELECT query_id, sum(weight) AS total FROM w GROUP BY 1),
b AS (SELECT query_id, source, max(own / total) AS score FROM s JOIN t USING (query_id) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source) AS INTEGER) AS rank, source, round(score, 6) AS score FROM b QUALIFY rank <= 3"""


@query("rag_retrieve", RETRIEVED_SQL)
def rag_retrieve(spark, sf_dir):
    return retrieval.retrieve(retrieval.chunks(_docs(spark, sf_dir)), _asked(spark)).select("query_id", "rank", "source", F.round("score", 6).alias("score"))


@query("rag_indexed", RETRIEVED_SQL)
def rag_indexed(spark, sf_dir):
    """As rag_retrieve, through a stored index that two loads have filled."""
    path = scratch(spark, "postings")
    docs = retrieval.chunks(_docs(spark, sf_dir))
    first = F.pmod(F.xxhash64("source"), F.lit(2)) == 0
    postings.append(docs.filter(first), path)
    postings.append(docs.filter(~first), path)
    return postings.retrieve(spark, path, _asked(spark)).select("query_id", "rank", "source", F.round("score", 6).alias("score"))


@query("rag_citations")
def rag_citations(spark, sf_dir):
    """Citations checked against their sources; every row has to be valid."""
    docs = _docs(spark, sf_dir)
    cited = retrieval.citations(retrieval.chunks(docs), _asked(spark))
    return retrieval.verified(cited, docs).select("query_id", "rank", "source", "score", "char_start", "char_end", "valid")


@query("vector_topk", """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS s FROM embeddings, q) QUALIFY rank <= 10""")
def vector_topk(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(e, asked, 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_hundredths", """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS s FROM embeddings, q) QUALIFY rank <= 3""")
def vector_topk_hundredths(spark, sf_dir):
    """The whole set of a search's queries: every row whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(e, asked).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("embed_letters", """SELECT item_id, array_to_string(list_transform(range(0, 32), lambda k: len(list_filter(string_split(lower(text), ''), lambda c: unicode(c) % 32 = k))), ',') AS histogram FROM benchmark""")
def embed_letters(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.transform(letter_histogram(F.col("text")), lambda x: x.cast("int").cast("string")), ",").alias("histogram"))


@query("curator_tags", f"""WITH t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#-]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in intake.TAG_STOPWORDS)})) AS toks FROM documents)),
n AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS pos FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM n)
SELECT doc_id, string_agg(tok, ',' ORDER BY k) AS tags FROM r WHERE k <= 6 GROUP BY 1""")
def curator_tags(spark, sf_dir):
    return intake.tags(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.array_join("tags", ",").alias("tags"))


def _case(rules: dict, column: str, default: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'''contains({column}, '{w}')''' for w in words)} THEN '{name}'" for name, words in rules.items())
    return f"CASE {whens} ELSE '{default}' END"


def _list(rules: dict, column: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'''contains({column}, '{w}')''' for w in words)} THEN '{name}' END" for name, words in rules.items()) + ")"


@query("intake_topics", f"SELECT doc_id, {_case(intake.CATEGORIES, 'lower(text)', 'general')} AS category, {_list(intake.TOPICS, 'lower(text)')} AS topics, {_list({w: [w] for w in sorted(intake.RISK_TERMS)}, 'lower(text)')} AS risk_flags FROM documents")
def intake_topics(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", intake.category(t).alias("category"), F.array_join(intake.all_topics(t), ",").alias("topics"), F.array_join(intake.risk_flags(t), ",").alias("risk_flags"))


@query("task_priority", r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[\n;]+'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-*•]+', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS parts FROM conversations)
SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS idx, unnest(parts) AS task,
CASE WHEN regexp_matches(lower(task), 'urgent|asap|critical|deadline|today|now|blocker|blocked|immediately|waiting on|depends on') THEN 'high' WHEN regexp_matches(lower(task), 'someday|later|eventually|nice to have|optional|backlog|low priority') THEN 'low' ELSE 'medium' END AS priority FROM t""")
def task_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return intake.tasks(rows, "k").select("k.conv_id", "k.turn", "idx", "task", "priority")


@query("slugs", r"""SELECT p_partkey, trim(substr(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-') AS slug FROM part""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("titles", r"""WITH l AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\r?\n|\r'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '') AS lines, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM documents),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lines[1], '^\s+|\s+$', '', 'g'), '^#+', ''), '^\s+|\s+$', '', 'g') AS plain, list_filter(string_split(regexp_replace(one, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sents FROM l),
f AS (SELECT *, trim(regexp_replace(regexp_replace(string_split(regexp_replace(plain, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1], '[.!?]+$', ''), '\s+', ' ', 'g')) AS first, coalesce(sents[1], '') AS s,
 list_filter(list_transform(regexp_split_to_array(text, '\r?\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '^[-*•]')) AS bullets FROM p)
SELECT doc_id, CASE WHEN coalesce(plain, '') = '' THEN 'Untitled Note' WHEN length(first) <= 80 THEN first ELSE rtrim(substr(first, 1, 79)) || '…' END AS title, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 239)) || '…' END AS summary,
CAST(least(5, CASE WHEN len(bullets) > 0 THEN len(bullets) ELSE len(sents) END) AS INTEGER) AS n_points FROM f""")
def titles(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", intake.title(t).alias("title"), intake.summary(t).alias("summary"), F.size(intake.key_points(t)).alias("n_points"))


VULN_SQL = """v AS (SELECT p_partkey, 'V-' || p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size * 37 % 105) / 10.0 END AS cvss, CASE WHEN p_size % 3 = 0 THEN 'High' WHEN p_size % 3 = 1 THEN ' low ' ELSE 'odd' END AS sev, p_brand AS asset, p_size % 4 = 0 AS expl, p_size % 6 = 0 AS exposed FROM part),
a AS (SELECT *, CASE WHEN cvss BETWEEN 0 AND 10 THEN CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END WHEN lower(trim(sev)) IN ('high', 'low') THEN lower(trim(sev)) ELSE 'unknown' END AS priority FROM v),
s AS (SELECT *, CAST(least(100, CASE priority WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 45 WHEN 'low' THEN 20 ELSE 10 END + CASE WHEN expl THEN 15 ELSE 0 END + CASE WHEN exposed THEN 10 ELSE 0 END) AS INTEGER) AS score FROM a)"""


def _findings(spark, sf_dir) -> DataFrame:
    size = F.col("p_size").cast("int")
    severity = F.when(size % 3 == 0, "High").when(size % 3 == 1, " low ").otherwise("odd")
    cvss = F.when(size % 5 != 0, (size * 37 % 105) / 10.0)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("V-"), F.col("p_partkey").cast("string")).alias("id"), cvss.alias("cvss"), severity.alias("severity"), F.col("p_brand").alias("asset"), F.when(size % 4 == 0, "yes").otherwise("no").alias("exploit_available"), (size % 6 == 0).alias("exposed"))


@query("vuln_ranked", f"WITH {VULN_SQL} SELECT id, priority, score, CASE priority WHEN 'critical' THEN '24-48 hours' WHEN 'high' THEN 'within 7 days' WHEN 'medium' THEN 'within 30 days' WHEN 'low' THEN 'within 90 days' ELSE 'triage to assign a severity first' END AS \"window\" FROM s")
def vuln_ranked(spark, sf_dir):
    return vulnerability.ranked(_findings(spark, sf_dir)).select("id", "priority", "score", "window")


@query("vuln_counts", f"WITH {VULN_SQL} SELECT p AS priority, count(id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('unknown')) t(p) LEFT JOIN s ON s.priority = p GROUP BY 1")
def vuln_counts(spark, sf_dir):
    return vulnerability.counts(_findings(spark, sf_dir))


@query("vuln_per_asset", f"WITH {VULN_SQL} SELECT asset, CAST(row_number() OVER (PARTITION BY asset ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM s QUALIFY place <= 3")
def vuln_per_asset(spark, sf_dir):
    return vulnerability.per_asset(_findings(spark, sf_dir)).select("asset", "place", "id", "score")


STATUS_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'error' WHEN 3 THEN 'attested' ELSE 'manual' END"


def _results(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ("pass", "fail", "error", "attested", "manual"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    frameworks = F.array(F.lit("ALL"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("ALL"))
    return o.select(F.col("o_orderkey").alias("control_id"), status.alias("status"), F.col("o_orderstatus").alias("category"), frameworks.alias("frameworks"), F.date_format("o_orderdate", "yyyy-MM").alias("recorded_at"))


@query("compliance_frameworks", f"""WITH e AS (SELECT unnest(['ALL', o_orderstatus, o_orderpriority]) AS framework, {STATUS_SQL} AS status FROM orders), g AS (SELECT framework, count(*) FILTER (status IN ('pass', 'attested')) AS passing, count(*) AS total FROM e GROUP BY 1)
SELECT framework, passing, total, CAST(round_even(100.0 * passing / total, 0) AS INTEGER) AS percent FROM g""")
def compliance_frameworks(spark, sf_dir):
    return compliance.by_framework(_results(spark, sf_dir))


@query("compliance_score", f"""SELECT count(*) FILTER (status = 'pass') AS passing, count(*) AS total, CAST(round_even(100.0 * count(*) FILTER (status = 'pass') / count(*), 0) AS INTEGER) AS percent FROM (SELECT {STATUS_SQL} AS status FROM orders) WHERE status IN ('pass', 'fail', 'error')""")
def compliance_score(spark, sf_dir):
    return compliance.score(_results(spark, sf_dir))


@query("compliance_categories", f"""WITH g AS (SELECT o_orderstatus AS category, count(*) FILTER ({STATUS_SQL} IN ('pass', 'attested')) AS passing, count(*) AS total FROM orders GROUP BY 1) SELECT category, passing, total, CAST(round_even(100.0 * passing / total, 0) AS INTEGER) AS percent FROM g""")
def compliance_categories(spark, sf_dir):
    return compliance.by_category(_results(spark, sf_dir))


@query("posture_trend", f"""WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS recorded_at, count(*) FILTER ({STATUS_SQL} = 'pass') AS passing, count(*) AS total FROM orders WHERE {STATUS_SQL} IN ('pass', 'fail', 'error') GROUP BY 1) SELECT recorded_at, passing, total, CAST(round_even(100.0 * passing / total, 0) AS INTEGER) AS percent FROM g""")
def posture_trend(spark, sf_dir):
    return compliance.trend(_results(spark, sf_dir))


@query("status_tally", f"""SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('pass'), ('fail'), ('error'), ('attested'), ('manual'), ('retired')) t(s) LEFT JOIN orders ON {STATUS_SQL} = s GROUP BY 1""")
def status_tally(spark, sf_dir):
    return compliance.tally(_results(spark, sf_dir), [*compliance.STATUSES, "retired"])


@query("attested_controls", """SELECT c_custkey AS control_id, CASE WHEN c_custkey % 3 = 0 THEN 'pass' WHEN c_custkey % 3 = 1 AND c_custkey % 50 BETWEEN 10 AND 40 THEN 'attested' ELSE 'manual' END AS status FROM customer""")
def attested_controls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("control_id"))
    controls = c.withColumn("checked", F.when(F.col("control_id") % 3 == 0, "pass"))
    as_of, k = F.lit("2026-08-21").cast("date"), (F.col("control_id") % 50).cast("int")
    claims = c.filter("control_id % 3 = 1").select("control_id", F.date_sub(as_of, k - 10).alias("date"), F.date_add(as_of, F.lit(40) - k).alias("expires"), F.lit("someone").alias("attested_by"))
    return compliance.with_attestations(controls, claims, as_of).select("control_id", "status")


LOG_SQL = """l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, 'c' || o_custkey AS actor, o_orderstatus AS decision, sha256('k' || o_orderkey) AS link, o_orderkey FROM orders),
e AS (SELECT *, CASE WHEN seq = 0 THEN repeat('0', 64) ELSE lag(link) OVER (ORDER BY seq) END AS prev FROM l)"""


@query("audit_chain", f"""WITH {LOG_SQL} SELECT count(*) AS entries, max(seq) AS head_seq, min(seq) FILTER (seq % 1000 = 777) AS first_bad_seq, CASE WHEN max(seq) >= 777 THEN 'hash mismatch' END AS problem, max(seq) < 777 AS intact FROM e""")
def audit_chain(spark, sf_dir):
    """Orders as a chained log in which every thousandth entry was edited after it was written.

    To have a chain without a sequential fold, an entry's hash covers its fields and a link that is known beforehand.
    """
    rows = _chained(spark, sf_dir)
    return audit.report(rows, fields=["seq", "actor", "decision"]).select("entries", "head_seq", "first_bad_seq", "problem", "intact")


def _chained(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # a dense sequence number by ranges: counts per range first, then places within it
    width = 4096
    ranges = o.groupBy(F.floor(F.col("o_orderkey") / width).alias("r")).count()
    starts = ranges.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = o.withColumn("r", F.floor(F.col("o_orderkey") / width)).join(starts.select("r", "start"), "r")
    own = own.withColumn("seq", F.col("start") + F.row_number().over(Window.partitionBy("r").orderBy("o_orderkey")) - 1)
    own = own.withColumns({"actor": F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "decision": F.col("o_orderstatus")})
    own = own.withColumn("entry_hash", audit.entry_hash(["seq", "actor", "decision"]))
    previous = own.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("prev_hash"))
    rows = own.join(previous, "seq", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit(audit.GENESIS)))
    return rows.withColumn("actor", F.when(F.col("seq") % 1000 == 777, "edited").otherwise(F.col("actor"))).select("seq", "actor", "decision", "prev_hash", "entry_hash")


KINDS_SQL = "CASE l_linenumber WHEN 1 THEN 'submitted' WHEN 2 THEN 'submitted' WHEN 3 THEN 'resolved' ELSE 'consumed' END"


def _queue(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") <= 2, "submitted").when(F.col("l_linenumber") == 3, "resolved").otherwise("consumed")
    return li.select(F.col("l_linenumber").alias("line"), kind.alias("kind"), F.col("l_orderkey").alias("ref"), F.col("l_partkey").cast("string").alias("payload"))


@query("approvals_pending", """SELECT l_orderkey AS ref, max(l_linenumber) AS line, arg_max(CAST(l_partkey AS VARCHAR), (l_linenumber, CAST(l_partkey AS VARCHAR))) AS payload FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) GROUP BY 1""")
def approvals_pending(spark, sf_dir):
    return audit.pending(_queue(spark, sf_dir))


@query("approvals_counts", """SELECT count(*) AS records, count(DISTINCT l_orderkey) FILTER (l_linenumber = 3) AS resolved, count(DISTINCT l_orderkey) FILTER (l_linenumber > 3) AS consumed,
(SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)) AS pending FROM lineitem""")
def approvals_counts(spark, sf_dir):
    return audit.queue_counts(_queue(spark, sf_dir))


@query("lock_drift", """SELECT 'pkg-' || s_suppkey AS name, '1.' || (s_suppkey % 7) AS version, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE '1.' || (s_suppkey % 5) END AS expected FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 7 <> s_suppkey % 5""")
def lock_drift(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    lines = s.select(F.concat(F.lit("Pkg_"), key.cast("string"), F.lit("==1."), (key % 7).cast("string"), F.lit(" ; python_version > '3'")).alias("value"))
    truth = s.filter("s_suppkey % 11 <> 0").select(F.concat(F.lit("pkg-"), key.cast("string")).alias("name"), F.concat(F.lit("1."), (key % 5).cast("string")).alias("version"))
    return inventory.drift(inventory.pins(lines), truth)


@query("lock_ambiguous", """SELECT 'p' || (p_partkey % 50) AS name, count(DISTINCT p_size) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1""")
def lock_ambiguous(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return inventory.ambiguous(p.select(F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("name"), F.col("p_size").alias("version")))


@query("ledger_merge", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'new' END AS v FROM customer WHERE c_custkey % 2 = 0) b USING (k)""")
def ledger_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, "new").alias("v"))
    return graph.merged_ledger(old, new, "k")


@query("sbom_merge", """SELECT DISTINCT 'pkg:npm/%40s/p' || (l_partkey % 500) || '@' || (l_suppkey % 3) AS purl FROM lineitem""")
def sbom_merge(spark, sf_dir):
    from ..functions.text import npm_purl

    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("@s/p"), (F.col("l_partkey") % 500).cast("string"))
    own = li.select(npm_purl(name, (F.col("l_suppkey") % 3).cast("string")).alias("purl"))
    return inventory.merged(own, own)


@query("size_parts", """WITH RECURSIVE i AS (SELECT o_custkey AS g, o_orderkey AS k, CAST(o_orderkey % 9 + 1 AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
p AS (SELECT g, k, r, n AS used, 0 AS part FROM i WHERE r = 1 UNION ALL SELECT i.g, i.k, i.r, CASE WHEN p.used + i.n > 20 THEN i.n ELSE p.used + i.n END, CASE WHEN p.used + i.n > 20 THEN p.part + 1 ELSE p.part END FROM p JOIN i ON i.g = p.g AND i.r = p.r + 1)
SELECT g, k, CAST(part AS INTEGER) AS part FROM p""")
def size_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 9 + 1).alias("n"))
    return inventory.parts(o, "g", "k", "n", 20)


@query("successor_chain", """WITH RECURSIVE l AS (SELECT 'T' || n_nationkey AS t, 'T' || (n_nationkey // 2) AS s FROM nation WHERE n_nationkey > 0), w AS (SELECT t, s AS cur, 1 AS n FROM l UNION ALL SELECT w.t, l.s, w.n + 1 FROM w JOIN l ON l.t = w.cur WHERE w.n < 11)
SELECT t AS technique_id, arg_max(cur, n) AS current, CAST(max(n) AS INTEGER) AS n_hops, false AS looped FROM w GROUP BY 1""")
def successor_chain(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey > 0")
    links = n.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("technique_id"), F.concat(F.lit("T"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("successor"))
    return graph.resolved(links)


@query("technique_references", """SELECT DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE 'T' || (1000 + o_orderkey % 60) END AS technique_id, CASE WHEN o_orderkey % 7 = 0 THEN 'malformed' WHEN o_orderkey % 60 < 30 THEN 'active' WHEN o_orderkey % 60 < 40 THEN 'revoked' ELSE 'unknown' END AS status FROM orders""")
def technique_references(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    asked = o.select(F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.concat(F.lit("T"), (1000 + F.col("o_orderkey") % 60).cast("string"))).alias("technique_id"))
    active = spark.range(30).select(F.concat(F.lit("T"), (1000 + F.col("id")).cast("string")).alias("technique_id"), F.lit("active").alias("status"))
    gone = spark.range(30, 40).select(F.concat(F.lit("T"), (1000 + F.col("id")).cast("string")).alias("technique_id"), F.lit("revoked").alias("status"), F.lit("T1000").alias("successor"))
    return graph.references(asked, active, gone).select("technique_id", "status")


@query("related_sets", """WITH e AS (SELECT DISTINCT 'P' || (l_partkey % 100) AS technique_id, 'S' || (l_suppkey % 40) AS nm, CASE l_linenumber % 3 WHEN 0 THEN 'mitigations' WHEN 1 THEN 'groups' ELSE 'software' END AS st FROM lineitem)
SELECT technique_id, coalesce(string_agg(nm, ',' ORDER BY nm) FILTER (st = 'mitigations'), '') AS mitigations, coalesce(string_agg(nm, ',' ORDER BY nm) FILTER (st = 'groups'), '') AS groups, coalesce(string_agg(nm, ',' ORDER BY nm) FILTER (st = 'software'), '') AS software FROM e GROUP BY 1""")
def related_sets(spark, sf_dir):
    """The line items as a graph of parts that suppliers mitigate or use."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), (F.col("l_partkey") % 100).cast("string")).alias("t"), F.concat(F.lit("S"), (F.col("l_suppkey") % 40).cast("string")).alias("s"), (F.col("l_linenumber") % 3).alias("k")).distinct()
    kind = F.when(F.col("k") == 0, "course-of-action").when(F.col("k") == 1, "intrusion-set").otherwise("tool")
    own = li.select(F.concat("s", F.col("k").cast("string")).alias("id"), kind.alias("type"), F.col("s").alias("name"), F.col("s").alias("external_id")).distinct()
    parts = li.select(F.col("t").alias("id"), F.lit("attack-pattern").alias("type"), F.col("t").alias("name"), F.col("t").alias("external_id")).distinct()
    edges = li.select(F.when(F.col("k") == 0, "mitigates").otherwise("uses").alias("kind"), F.concat("s", F.col("k").cast("string")).alias("source"), F.col("t").alias("target"))
    sets = graph.related_sets(edges, own.unionByName(parts))
    return sets.select("technique_id", *[F.array_join(c, ",").alias(c) for c in ("mitigations", "groups", "software")])


@query("newer_versions", """SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey // 1000 AS a, o_orderkey % 20 AS b FROM orders) WHERE (a, b) > (3, 9)""")
def newer_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return graph.newer_versions(o.select(F.concat_ws(".", F.floor(F.col("o_orderkey") / 1000).cast("string"), (F.col("o_orderkey") % 20).cast("string")).alias("version")), "3.9")


@query("event_epochs", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN floor(epoch_us(ts) / 1e6) WHEN 2 THEN NULL ELSE floor(epoch_us(ts) / 1e6) END AS epoch FROM events""")
def event_epochs(spark, sf_dir):
    """Times written in four ways, one of them no time at all, and read again."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k, seconds = F.col("event_id") % 4, F.unix_seconds("ts")
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, (seconds * 1000).cast("string")).when(k == 2, "now").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    return e.select("event_id", epoch(text).alias("epoch"))
