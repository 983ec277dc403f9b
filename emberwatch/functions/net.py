"""IP addresses and ranges of both versions as numbers, without Python: version 4 as one long, version 6 as two."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound

STRICT_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?=[0-9])|$)){4}$"
LOOSE_V4 = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def is_dotted_quad(text: Column) -> Column:
    """Four numbers up to 255; leading zeros pass."""
    parts = F.split(text, r"\.")
    return F.coalesce(F.when(F.rlike(text, F.lit(LOOSE_V4)), F.forall(parts, lambda p: p.try_cast("int") <= 255)).otherwise(False), F.lit(False))


def is_strict_v4(text: Column) -> Column:
    """As is_dotted_quad, but a leading zero is refused."""
    return F.coalesce(F.rlike(text, F.lit(STRICT_V4)), F.lit(False))


def is_v6(text: Column) -> Column:
    """Strict test for a version 6 address: eight groups, or fewer around one double colon; the last two may be
    dotted, and a scope may follow a percent sign."""
    body = F.regexp_replace(text, r"^([^%]*)%[^%]+$", "$1")
    body = F.regexp_replace(body, r"(?<=:)" + STRICT_V4[1:], "0:0")
    groups = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
    whole = F.rlike(body, F.lit(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"))
    short = F.rlike(body, F.lit(f"^(?:{groups})?::(?:{groups})?$")) & (F.size(F.filter(F.split(body, ":"), lambda g: g != "")) <= 7)
    return F.coalesce(F.contains(text, F.lit(":")) & (whole | short), F.lit(False))


def is_ip(text: Column) -> Column:
    """Strict test for a version 4 or 6 address, without Python."""
    return is_strict_v4(text) | is_v6(text)


def v4_number(text: Column) -> Column:
    """A strict version 4 address as a number; null otherwise."""
    p = F.split(text, r"\.")
    n = reduce(lambda a, k: a * 256 + F.get(p, F.lit(k)).try_cast("long"), range(1, 4), F.get(p, F.lit(0)).try_cast("long"))
    return F.when(is_strict_v4(text), n)


def bounds(cidr: str) -> tuple[int, int, int]:
    """Version, first and last number of a range."""
    net = ipaddress.ip_network(cidr, strict=False)
    return net.version, int(net.network_address), int(net.broadcast_address)


def in_v4(number: Column, cidrs: list[str]) -> Column:
    """Whether a v4_number lies in one of the ranges; ranges of version 6 hold none."""
    tests = [number.between(lo, hi) for v, lo, hi in map(bounds, cidrs) if v == 4]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def v6_bits(text: Column) -> Column:
    """A version 6 address as struct (hi, lo) of two longs, its bits in order; null for any other text."""
    body = F.regexp_replace(text, "%[^%]+$", "")
    last = v4_number(F.regexp_extract(body, "([0-9.]+)$", 1))
    body = F.when(F.contains(body, F.lit(".")), F.concat(F.regexp_replace(body, "[0-9.]+$", ""), F.hex(F.shiftright(last, 16)), F.lit(":"), F.hex(last.bitwiseAND(0xFFFF)))).otherwise(body)
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        return F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)

    def number(all_groups: Column, at: int) -> Column:
        parts = [F.shiftleft(F.conv(F.get(all_groups, F.lit(at + k)), 16, 10).cast("long"), 48 - 16 * k) for k in range(4)]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    both = bound(bound(F.split(body, "::", -1), filled), lambda g: F.struct(number(g, 0).alias("hi"), number(g, 4).alias("lo")))
    return F.when(is_v6(text), both)


def _long(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def in_v6(bits: Column, cidrs: list[str]) -> Column:
    """Whether v6_bits lie in one of the ranges; ranges of version 4 hold none."""
    tests = []
    for net in (ipaddress.ip_network(c, strict=False) for c in cidrs if ":" in c):
        mask, first = int(net.netmask), int(net.network_address)
        same = [bits[k].bitwiseAND(F.lit(_long(mask >> by & (1 << 64) - 1)).cast("long")) == F.lit(_long(first >> by & (1 << 64) - 1)).cast("long") for k, by in (("hi", 64), ("lo", 0))]
        tests.append(same[0] & same[1])
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def in_any(text: Column, cidrs: list[str]) -> Column:
    """Whether a version 4 or 6 address lies in one of the ranges. Version 6 is only looked at where a colon is."""
    four = in_v4(v4_number(text), cidrs)
    if not any(":" in c for c in cidrs):
        return four
    return four | F.when(F.contains(text, F.lit(":")), bound(v6_bits(text), lambda b: in_v6(b, cidrs))).otherwise(False)


def numbered(text: Column) -> Column:
    """struct (version, hi, lo): an address of either version as its bits; null for any other text."""
    part = lambda version, hi, lo: F.struct(F.lit(version).alias("version"), hi.alias("hi"), lo.alias("lo"))
    six = bound(v6_bits(text), lambda b: F.when(b.isNotNull(), part(6, b["hi"], b["lo"])))
    return F.when(is_strict_v4(text), part(4, F.lit(0).cast("long"), v4_number(text))).when(F.contains(text, F.lit(":")), six)


def prefix_key(address: Column, length: Column) -> Column:
    """struct (version, length, hi, lo): the first `length` bits of a numbered address, by which it meets the range of that length;
    null if there is no address or it has fewer bits."""
    # a shift by 64 is one by 0 in Java
    ones = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - n).cast("int")))
    four = address["version"] == 4
    hi, lo = address["hi"].bitwiseAND(F.when(four, ones(length + 64)).otherwise(ones(length))), address["lo"].bitwiseAND(F.when(four, ones(length + 32)).otherwise(ones(length - 64)))
    own = F.struct(address["version"].alias("version"), length.cast("int").alias("length"), hi.alias("hi"), lo.alias("lo"))
    return F.when(length.between(0, F.when(four, 32).otherwise(128)) & address.isNotNull(), own)


def in_ranges(addresses: DataFrame, ranges: DataFrame, *, value: str = "value", cidr: str = "cidr", read: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """value, cidr for each distinct address of either version: the longest of the ranges that hold it; addresses in none are left out.

    Ranges meet addresses by equality of their first bits, once for each length that a range has (at most 33 and 129), so neither
    side is compared with all of the other. Texts that aren't addresses or ranges hold nothing and lie in nothing.
    read: the address that a text of either side stands for, where they are written in a way of their own.
    """
    slash = F.substring_index(cidr, "/", -1)
    length = F.when(F.contains(F.col(cidr), F.lit("/")), slash.try_cast("int")).otherwise(F.when(F.contains(F.col(cidr), F.lit(":")), 128).otherwise(32))
    # texts are columns before they are read, and are read in an explosion, below which no filter repeats what reads them
    address = F.explode(F.array_compact(F.array(numbered(F.col("text"))))).alias("address")
    own = ranges.select(F.col(cidr).alias("cidr"), length.alias("length"), read(F.substring_index(cidr, "/", 1)).alias("text")).select("cidr", "length", address)
    own = own.select("cidr", prefix_key(F.col("address"), F.col("length")).alias("key")).filter("key is not null").groupBy("key").agg(F.min("cidr").alias("cidr"))
    lengths = [tuple(r) for r in own.select("key.version", "key.length").distinct().collect()]  # 162 at most
    asked = addresses.select(F.col(value).alias("value"), read(F.col(value)).alias("text")).distinct().select("value", address)
    of = {v: F.array(*[F.lit(n) for w, n in sorted(lengths) if w == v]).cast("array<int>") for v in (4, 6)}
    each = asked.select("value", "address", F.explode(F.when(F.col("address.version") == 6, of[6]).otherwise(of[4])).alias("length"))
    met = each.select("value", prefix_key(F.col("address"), F.col("length")).alias("key")).join(own, "key")
    return met.groupBy("value").agg(F.max_by("cidr", "key.length").alias("cidr"))
