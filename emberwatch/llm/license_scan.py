"""License scan as an exact set-similarity join, in DataFrame operations only.

Texts are lists of words. For every template, windows of twice its length (rounded up to a power of two), each starting
half-way into the one before, are the text blocks: a passage as long as the template lies whole in one of them,
and words further apart than that don't count together. A block matches a template if it holds at
least `least` of its distinct words, or all of them if it has fewer than SHORT. Words are ordered by the
number of texts that hold them, rarest first; a matching block must hold one of the template's first n - need + 1 words
(prefix filter), have `need` of its words at all (length filter), and have enough words left after the first
shared one on both sides (positional filter); what is left is verified. The first two filters are applied to whole
texts first, so that only texts that can match are cut into blocks.

Defined cases: null text counts as empty and has no words; repeated rows give a row each; null ids
are ids like any other; an empty table gives no rows; no templates give base labels only; columns other
than doc_id and text are not looked at, whatever they are called.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_az
from .license_texts import TEXTS

# In lower-cased text [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ finds the same words, but a class of ranges that are in is much faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
#: Phrases whose words standing consecutively name a license.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = TEXTS
LEAST, SHORT = 0.8, 15
#: As many rows of candidate texts are broadcast at most; more are joined by sorting.
FEW = 100_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(text), F.lit(WORD), F.lit(0))


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == p)
        return F.coalesce(out, F.lit(False))

    return F.when(F.array_contains(words, parts[0]), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def _rows(docs: DataFrame) -> DataFrame:
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _base(docs: DataFrame, phrases: dict[str, str], vocabulary: list[str]) -> DataFrame:
    """doc_id, text_key, n_words, starts, base, seen (distinct words of the vocabulary)."""
    df = _rows(docs).select("doc_id", "text_key", _words(F.col("text")).alias("words"))
    for k, phrase in enumerate(phrases):
        df = df.withColumn(f"p{k}", _phrase_starts(F.col("words"), phrase))
    starts = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, label in enumerate(phrases.values())]))
    seen = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))) if vocabulary else F.array().cast("array<string>")
    return df.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), starts.alias("starts"), F.array_sort(F.array_distinct(labels)).alias("base"), seen.alias("seen"))


def template_sets(templates: dict[str, list[str]], least: float) -> list[tuple[str, list[str], int, int]]:
    """Label, distinct words, how many of them a block needs, and the block's step (half its size) of each template."""
    out = []
    for label, texts in templates.items():
        for text in texts:
            words = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
            n = len(own := sorted(set(words)))
            out.append((label, own, n if n < SHORT else math.ceil(least * n - 1e-9), max(8, 1 << (len(words) - 1).bit_length())))
    return out


def _joined(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows that have one of the (doc_id, text_key) of keys, with the other columns of keys."""
    keys = keys.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), *[c for c in keys.columns if c not in ("doc_id", "text_key")])
    keys = F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__t"))).drop("__d", "__t")


def template_matches(docs: DataFrame, light: DataFrame, sets: list[tuple[str, list[str], int, int]]) -> DataFrame:
    """Rows (doc_id, text_key, block, label, containment) for every block and template that match; light: what _base gives."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, own, _, _ in sets for w in own})
    n = {r["word"]: r["count"] for r in light.select(F.explode("seen").alias("word")).groupBy("word").count().collect()}  # words of templates only
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}
    named, prefixes = [], []
    for k, (label, own, need, step) in enumerate(sets):
        own = sorted(own, key=rank.get)
        named.append((k, label, own))
        prefixes += [(w, k, at, len(own), need, step) for at, w in enumerate(own[: len(own) - need + 1])]
    firsts = sorted({p[0] for p in prefixes})
    # Both tables are made of the templates, so their size is that of the parameter.
    index = F.broadcast(spark.createDataFrame(prefixes, "word string, template int, at int, size int, need int, step int"))
    full = F.broadcast(spark.createDataFrame(named, "template int, label string, own array<string>"))
    likely = light.filter(F.size("seen") >= min(need for _, _, need, _ in sets))
    likely = likely.select("doc_id", "text_key", F.size("seen").alias("have"), F.explode(F.filter("seen", lambda w: w.isin(firsts))).alias("word"))
    likely = likely.join(index, "word").filter("have >= need").select("doc_id", "text_key", "step", "template").distinct()
    likely = cut(likely.groupBy("doc_id", "text_key").agg(F.collect_set("step").alias("steps"), F.collect_set("template").alias("templates")))  # at most one each per template
    ranks = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    words = _joined(_rows(docs), likely).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "templates", F.explode("steps").alias("step"), _words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("step"))
    block = F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, 2 * F.col("step")).alias("words"))))
    blocks = words.select("doc_id", "text_key", "templates", "step", block.alias("b"))
    blocks = blocks.select("doc_id", "text_key", "templates", "step", F.col("b.at").alias("block"), F.array_distinct(F.filter("b.words", lambda w: w.isin(vocabulary))).alias("own_words"))
    blocks = blocks.filter(F.size("own_words") >= min(need for _, _, need, _ in sets))
    ordered = F.array_sort(F.transform("own_words", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word"))))
    blocks = blocks.withColumn("own_words", F.transform(ordered, lambda x: x["word"]))
    tokens = blocks.select("doc_id", "text_key", "block", "templates", F.col("step").alias("__step"), "own_words", F.posexplode("own_words").alias("i", "word"))
    left = 1 + F.least(F.size("own_words") - 1 - F.col("i"), F.col("size") - 1 - F.col("at"))
    pairs = tokens.join(index, "word").filter((F.col("step") == F.col("__step")) & F.array_contains("templates", F.col("template")))
    pairs = pairs.filter((F.size("own_words") >= F.col("need")) & (F.col("i") + left >= F.col("need"))).join(full, "template")
    shared = F.array_intersect("own_words", "own")
    first = F.get(shared, F.lit(0)) == F.col("word")  # each pair is verified once, at its first shared word
    pairs = pairs.filter(first & (F.size(shared) >= F.col("need")))
    return pairs.select("doc_id", "text_key", "block", "label", (F.size(shared) / F.size("own")).alias("containment"))


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_words, starts (word places of phrases), base (labels), labels (with
    those of matching templates), score (1 if a phrase was found, else the largest containment of a template that matches, else 0).
    """
    sets = template_sets(templates, least)
    light = cut(_base(docs, phrases, sorted({w for _, own, _, _ in sets for w in own})))
    if not sets:
        return light.select("doc_id", "n_words", "starts", "base", F.col("base").alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(0.0).alias("score"))
    found = template_matches(docs, light, sets)
    found = found.groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = light.join(found, light["doc_id"].eqNullSafe(found["__d"]) & (light["text_key"] == found["__t"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "starts", "base", labels.alias("labels"), score.alias("score"))
