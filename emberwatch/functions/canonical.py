"""Canonical JSON and name-based ids as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: A float of at most 15 digits, without the zeros that only pad it.
FLOAT = r"(-?[0-9]+\.(?:[0-9]*[1-9]|0))0*(?![0-9])"
#: Numbers outside of texts whose shortest form would have to be computed: exponents, more than 15 digits, below 0.0001.
UNCLEAR = r"[0-9][eE]|[0-9]{38}|(?=[0-9.]{17})[0-9]*\.[0-9]|(?<![0-9])0\.0000[0-9]*[1-9]"
#: One half of a surrogate pair without the other, which no text in UTF-8 can hold.
LONE = r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}"
#: Precedes what stands between quotes but is a number.
MARK = "\\u0001="


def escaped(json: Column) -> Column:
    """JSON text in ASCII: all else as lower-case escapes of its UTF-16 units."""
    piece = F.regexp_extract_all(json, F.lit(r"\\u[0-9A-Fa-f]{4}|\\[^u]|[ -\[\]-~]+|[^ -~]+"), F.lit(0))

    def said(p: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(F.startswith(p, F.lit("\\u")), F.concat(F.lit("\\u"), F.lower(F.substring(p, 3, 4)))).when(p.rlike("^[^ -~]"), units).otherwise(p)

    return F.array_join(F.transform(piece, said), "")


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, no blanks and ASCII only, as json.dumps(sort_keys=True, separators=(",", ":")) writes it.

    Null where that can't be told: no JSON, repeated keys, half a surrogate pair, keys on both sides of U+10000 and U+E000
    (they sort by UTF-16 units here), and numbers with an exponent, of more than 15 digits with a point, of 38 digits or
    below 0.0001.
    """

    def numbers(pieces: Column) -> Column:
        # every second piece lies between quotes
        outside = F.filter(pieces, lambda p, i: i % 2 == 0)
        marked = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, FLOAT, F.lit('"' + MARK.replace("\\", "\\\\") + '$1"'))).otherwise(p))
        return F.when(~F.exists(outside, lambda p: p.rlike(UNCLEAR)), F.array_join(marked, '"'))

    # no quote within a text and no backslash before one, so that the quotes that are left begin and end texts
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    both = json.rlike(r"[\x{E000}-\x{FFFF}]|\\u[eEfF][0-9a-fA-F]{3}") & json.rlike(r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]")
    clear = ~(json.rlike(LONE) | both | json.contains(MARK))
    out = F.to_json(F.try_parse_json(bound(F.split(plain, '"'), numbers)))
    return F.when(clear, escaped(F.regexp_replace(out, '"' + MARK.replace("\\", "\\\\") + '([^"]*)"', "$1")))


def quoted(text: Column) -> Column:
    """A text as JSON in ASCII."""
    whole = F.to_json(F.struct(text.alias("t")))
    return escaped(F.substring(whole, F.lit(6), F.length(whole) - 6))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based id of version 5: SHA-1 over namespace and name, with the bits of version and variant."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), name.cast("binary")))
    # two bits of the digit stay
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
