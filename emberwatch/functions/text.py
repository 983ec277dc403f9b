"""Text helpers as column expressions; all of them keep null as null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_LIMIT = 2048
SENTENCE_END = r"(?<=[.!?])\s+"


def bound(value: Column, f) -> Column:
    """f of value, with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether text contains one of the needles; a null text contains nothing."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles]), F.lit(False))


def all_of(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, [F.contains(text, F.lit(n)) for n in needles]), F.lit(False))


def squeezed(text: Column) -> Column:
    """Runs of white space (any Unicode) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def coerced(text: Column, limit: int = FIELD_LIMIT) -> Column:
    """A field's text: line and tab runs as blanks, no control characters, trimmed, cut to limit; null if empty."""
    out = F.regexp_replace(F.regexp_replace(text, "[\\t\\n\\r]+", " "), "[\\x00-\\x1f\\x7f]", "")
    # most values are plain: no control characters, no white space at the ends
    odd = F.rlike(text, F.lit(r"[\x00-\x1f\x7f]|(?U:^\s|\s$)"))
    return F.nullif(F.substring(F.when(odd, stripped(out)).otherwise(text), 1, limit), F.lit(""))


def shortened(text: Column, limit: int) -> Column:
    """Squeezed text; if longer than limit, cut to it with an ellipsis as last character."""
    one = squeezed(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…")))


def slug(text: Column, limit: int = 60) -> Column:
    """Lower-case words joined by hyphens, at most limit characters."""
    dashed = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(dashed, 1, limit), F.lit("-"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(stripped(text), SENTENCE_END), lambda s: F.length(s) > 0)


def windows(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of (index, text, char_start): overlapping character windows, trimmed; blank ones are left out."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def one(at: Column, i: Column) -> Column:
        piece = F.substring(text, at + 1, F.lit(size))
        body = stripped(piece)
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
        return F.struct(i.cast("int").alias("index"), body.alias("text"), (at + lead).cast("int").alias("char_start"))

    return F.filter(F.transform(starts, one), lambda w: F.length(w["text"]) > 0)


def markdown_safe(text: Column, limit: int = 500) -> Column:
    """Text for a table cell: control characters as blanks, marks of Markdown and HTML escaped, cut to limit."""
    flat = F.substring(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]+", " "), 1, limit)
    html = F.replace(F.replace(flat, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(html, r"([\\`*_{}\[\]()#+!|-])", r"\\$1")


def sanitised_target(text: Column) -> Column:
    """A response target: other characters than names, addresses and accounts hold become hyphens; 120 at most."""
    return F.substring(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._:@-]", "-"), 1, 120)


def normalised_package(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[-_.]+", "-")


def npm_purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), F.regexp_replace(name, "^@", "%40"), F.lit("@"), version)


def sri_hex(integrity: Column) -> Column:
    """Hexadecimal digest of an integrity string such as sha512-<base64>."""
    return F.lower(F.hex(F.try_to_binary(F.regexp_extract(integrity, "^sha[0-9]+-(.*)$", 1), F.lit("base64"))))


def version_key(version: Column) -> Column:
    """Dotted version as an array of numbers, which compares in order; parts that aren't numbers are null."""
    return F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))


def parent_name(path: Column) -> Column:
    """Name of the folder a path lies in, or null."""
    return F.get(F.reverse(F.split(path, "/")), F.lit(1))
