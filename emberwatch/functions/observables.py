"""Observables of a text: URLs, hashes, addresses, domains, in that order, each once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .net import is_dotted_quad

URL = r"(?i)\bhttps?://[^\s\"'<>]+"
HASH = r"(?i)\b(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IPV6 = r"(?i)(?<![:.\w])(?:[a-f0-9]{1,4}:){2,7}(?::?[a-f0-9]{1,4})?(?![:.\w])"
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def observables(text: Column, limit: int = 64) -> Column:
    """At most `limit` observables; equal ones but for case count once, domains inside a URL not at all."""
    none = F.array().cast("array<string>")

    def rest(x: Column) -> Column:
        names = F.filter(found(F.regexp_replace(x["text"], URL, " "), DOMAIN), lambda d: ~F.exists(x["urls"], lambda u: F.contains(F.lower(u), F.lower(d))))
        return F.concat(x["urls"], found(x["text"], HASH), F.filter(found(x["text"], IPV4), is_dotted_quad), found(x["text"], IPV6), names)

    def once(every: Column) -> Column:
        lowered = F.transform(every, lambda x: F.lower(x))
        return F.filter(every, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)

    # each step is bound by a one-element array, so that it is written into the plan once
    step = F.transform(F.array(F.struct(text.alias("text"), found(text, URL).alias("urls"))), rest)
    return F.coalesce(F.slice(F.get(F.transform(step, once), F.lit(0)), 1, limit), none)


def sysmon_hashes(text: Column) -> Column:
    """Digests of a list such as SHA256=...,MD5=..."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(?i)(SHA256|SHA1|MD5|IMPHASH)=([a-f0-9]+)"), F.lit(2)), F.array().cast("array<string>"))
