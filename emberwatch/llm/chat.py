"""Chat formatting of logged conversations, after collapse of cumulative snapshots.

A log often holds a conversation again after every turn, each time one turn longer. A rolling hash over
the turns in order names every prefix; a conversation whose whole hash is a shorter prefix of
another is a snapshot of it and goes, by an anti-join on the hash. Of equal conversations the one with
the smallest id stays. What is left is rendered.

Defined cases: a null role or text counts as empty; turns are ordered by turn (nulls first), then, where
several rows have one turn number, by a hash of role and text; repeated rows (equal turn, role and text) of a conversation count once; a null conv_id is a
conversation of its own kind, all of its turns together, and loses ties; an empty table gives no
rows; columns other than those named are not looked at. One conversation is one row of the result,
so its turns meet in one task; the collapse itself moves hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Before and after each turn, with the role between the first two.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _turn_hash() -> Column:
    """Of role and text, told apart by the length that comes first."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _rolling(hashes: Column) -> Column:
    """Each turn's hash over all turns up to it."""
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        now = F.md5(F.concat(acc["last"], x))
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(hashes, start, add)["out"]


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, prefixes (rolling hash after each turn) of every conversation."""
    turns = _turns(conversations).select("conv_id", "turn", _turn_hash().alias("h")).distinct()
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("turns"))
    return ordered.select("conv_id", F.size("turns").alias("n_turns"), _rolling(F.col("turns.h")).alias("prefixes"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations, itself included) of the conversations that stay."""
    own = cut(prefixes(conversations))
    shorter = own.select(F.explode(F.slice("prefixes", 1, F.greatest(F.col("n_turns") - 1, F.lit(0)))).alias("hash")).distinct()
    whole = own.groupBy(F.element_at("prefixes", -1).alias("whole"), "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return whole.join(shorter, F.col("whole") == F.col("hash"), "left_anti").select("conv_id", "n_turns", "copies")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered of the conversations that stay."""
    kept = maximal(conversations)
    turns = _turns(conversations).distinct()
    rows = turns.withColumnRenamed("conv_id", "__c").join(kept, F.col("__c").eqNullSafe(F.col("conv_id")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", _turn_hash().alias("h"), "role", "text")))
    text = F.array_join(F.transform(ordered, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")
    return rows.groupBy("conv_id", "n_turns", "copies").agg(text.alias("rendered"))
