"""Sigma-style rules compiled to column expressions.

A rule is a mapping with `detection`: named selections (field, optional modifiers, value or values) and a
condition over them (not, and, or, parentheses, `N of p*`, `all of p*`). Compiling checks the whole rule;
what a malformed rule would raise is raised here, on the driver, never in a task. Matching ignores
case; a missing or null field matches no needle.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("critical", "high", "medium", "low", "informational")


class RuleError(ValueError):
    """A rule that can't be compiled."""


def _fold(values: list[Column], every: bool) -> Column:
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), values, F.lit(every))


#: Test of a lowered field against one lowered needle, by modifier.
MODIFIERS: dict[str, Callable[[Column, str], Column]] = {
    "": lambda c, v: c == v,
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "startswith": lambda c, v: F.startswith(c, F.lit(v)),
    "endswith": lambda c, v: F.endswith(c, F.lit(v)),
}


def field(name: str, columns: set[str]) -> Column:
    return F.coalesce(F.lower(F.col(f"`{name}`").cast("string")), F.lit("")) if name in columns else F.lit("")


def clause(key: str, value, columns: set[str]) -> Column:
    name, *mods = key.split("|")
    every = "all" in mods
    mods = [m for m in mods if m != "all"]
    if len(mods) > 1 or any(m not in MODIFIERS or not m for m in mods) or (every and mods != ["contains"]):
        raise RuleError(f"modifiers of {key!r} aren't known")
    mod = mods[0] if mods else ""
    if isinstance(value, (list, tuple)) and not mod:
        raise RuleError(f"{key!r} compares with a list but has no modifier")
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    test, own = MODIFIERS[mod], field(name, columns)
    return _fold([test(own, str(v).lower()) for v in values], every)


def selection(body, columns: set[str]) -> Column:
    if not isinstance(body, dict):
        raise RuleError("a selection has to be a mapping")
    return _fold([clause(k, v, columns) for k, v in body.items()], True)


TOKEN = re.compile(r"\s*(\(|\)|[^\s()]+)")


class _Parser:
    def __init__(self, text: str, named: dict[str, Column]) -> None:
        self.words, self.named, self.at = TOKEN.findall(text), named, 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self) -> str:
        if (word := self.peek()) is None:
            raise RuleError("the condition ends too early")
        self.at += 1
        return word

    def either(self) -> Column:
        out = self.both()
        while (self.peek() or "").lower() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while (self.peek() or "").lower() == "and":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        word = self.take()
        if word.lower() == "not":
            return ~self.one()
        if word == "(":
            out = self.either()
            if self.take() != ")":
                raise RuleError("a parenthesis isn't closed")
            return out
        if (self.peek() or "").lower() == "of":
            self.take()
            return self.several(word.lower(), self.take())
        if word not in self.named:
            raise RuleError(f"no selection {word!r}")
        return self.named[word]

    def several(self, count: str, pattern: str) -> Column:
        own = [c for n, c in self.named.items() if fnmatch.fnmatchcase(n, pattern)] if pattern.endswith("*") else []
        if not own:
            raise RuleError(f"no selections like {pattern!r}")
        if count == "all":
            return _fold(own, True)
        if not count.isdigit() or int(count) < 1:
            raise RuleError(f"{count!r} isn't a number of selections")
        return reduce(lambda a, b: a + b, [c.cast("int") for c in own]) >= int(count)


def condition(text, named: dict[str, Column]) -> Column:
    if not isinstance(text, str) or not text.strip():
        raise RuleError("the condition has to be text")
    parser = _Parser(text, named)
    out = parser.either()
    if parser.peek() is not None:
        raise RuleError(f"{parser.peek()!r} isn't expected in the condition")
    return out


def compiled(rule: dict, columns: list[str]) -> Column:
    """The rule as a boolean column over rows that have these columns."""
    if "correlation" in rule:
        raise RuleError("correlation rules are compiled by the correlation module")
    detection = rule.get("detection")
    if not isinstance(detection, dict):
        raise RuleError("a rule needs a detection")
    known = set(columns)
    named = {k: selection(v, known) for k, v in detection.items() if k != "condition"}
    return F.coalesce(condition(detection.get("condition"), named), F.lit(False))


def matches(df: DataFrame, rules: list[dict]) -> DataFrame:
    """df with `rules`, the names of the rules that match each row, in the order given; one projection, no shuffle."""
    hits = [F.when(compiled(r, df.columns), F.lit(r["name"])) for r in rules]
    return df.withColumn("rules", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))


def techniques(tags: list[str]) -> list[str]:
    """Technique ids among a rule's tags."""
    found = (re.fullmatch(r"attack\.(t\d{4}(?:\.\d{3})?)", t) for t in tags)
    return [m[1].upper() for m in found if m]


def level_rank(level: Column) -> Column:
    """0 for critical to 4 for informational, 99 for others."""
    return reduce(lambda c, x: c.when(level == x[1], x[0]), list(enumerate(LEVELS))[1:], F.when(level == LEVELS[0], 0)).otherwise(99)
