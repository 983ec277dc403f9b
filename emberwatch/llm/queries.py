"""Thin queries over the test tables, one per training-data operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, decontam, langid, license_scan, line_dedup, packing, pii, quality, simhash, spelling, warc
from .common import crc_mod, cut, scratch, table


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), ngram=3, bits=64, most=3)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.analyse(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.span_text(pii.KINDS).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.span_text((*pii.KINDS, "extra", "term")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=crc_mod(F.col("doc_id"), 3) != 1)
    held = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held, "lang_pred", "score")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=crc_mod(F.col("doc_id"), 5) != 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    held = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    scored = quality.scores(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations")).select("conv_id", F.col("n_turns").cast("long"), F.col("copies").cast("long"), "rendered")


CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
h AS (SELECT *, md5(length(role) || ':' || role || text) AS h FROM t),
o AS (SELECT conv_id, count(*) AS n_turns, list(h ORDER BY turn NULLS FIRST, h) AS hs,
      string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, h) AS rendered FROM h GROUP BY conv_id),
p AS (SELECT DISTINCT array_to_string(hs[1:k], '') AS prefix FROM (SELECT hs, unnest(range(1, n_turns)) AS k FROM o)),
k AS (SELECT min(conv_id) AS conv_id, count(*) AS copies FROM o WHERE array_to_string(hs, '') NOT IN (SELECT prefix FROM p) GROUP BY hs)
SELECT o.conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, rendered
FROM k JOIN o ON o.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return found.select(
        "metadata.page_id",
        "main.payload_bytes",
        "main.payload_digest",
        F.col("main.kind").alias("record_type"),
        F.when(F.col("main.kind") == "revisit", F.expr("try_cast(nullif(regexp_extract(main.refers_to, '^<urn:capture:(-?[0-9]+):', 1), '') AS bigint)")).alias("refers_to"),
    )


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(cut(packing.tokenised(table(spark, sf_dir, "documents"))))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), slip=199))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.applied(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10)
SELECT any_value(CAST(doc_id AS BIGINT)) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_langid": op3_langid,
    "op4_license_scan": op4_license_scan,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_ann": op8_ann,
    "op9_warc": op9_warc,
    "op10_best_fit": op10_best_fit,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_line_dedup": op13_line_dedup,
}


def _license_sql() -> str:
    own = license_scan
    phrases = ", ".join(f"({k}, '{p.split()[0]}', {p.split()}, '{label}')" for k, (p, label) in enumerate(own.PHRASES.items()))
    sets = ", ".join(f"('{label}', {words}, {len(words)}, {need}, {step})" for label, words, need, step in own.template_sets(own.TEMPLATES, own.LEAST))
    return f"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    p AS (SELECT * FROM (VALUES {phrases}) t(k, head, parts, label)),
    hits AS (SELECT r, i - 1 AS start, label FROM (SELECT r, words, unnest(generate_series(1, len(words))) AS i FROM w) JOIN p ON words[i] = head AND words[i : i + len(parts) - 1] = parts),
    base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY r),
    t AS (SELECT * FROM (VALUES {sets}) t(label, own, size, need, step)),
    s AS (SELECT DISTINCT step FROM t),
    b AS (SELECT r, step, list_distinct(words[i + 1 : i + 2 * step]) AS block FROM (SELECT r, words, step, unnest(range(0, greatest(len(words), 1), step)) AS i FROM w, s)),
    m AS (SELECT r, list(DISTINCT label) AS more, max(len(list_intersect(block, own)) / size) AS best FROM b JOIN t USING (step)
          WHERE len(list_intersect(block, own)) >= need GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN base USING (r) LEFT JOIN m USING (r)
    """


ORACLE_SQL: dict[str, str] = {"op4_license_scan": _license_sql(), "op7_chat": CHAT_SQL, "op13_line_dedup": LINES_SQL}
