"""Sequential scans with a reset, over groups of any size: items in order fill a part up to a budget, then the next begins at zero.

Where a part begins depends on all items before it, yet no task sees a whole group. A group is cut into blocks of consecutive items.
Of every item, the item that would begin the next part if this one began one is found by running sums: the target, the item's own
sum plus the budget, lies in a block whose sums overlap, and blocks meet by slots of their sums, each about two others.
Pointers are followed within each block by the block's task; what is left are pointers from block to block, of which only those
are kept that something points to. Doubling them finds the entry of every block in as many rounds as the number
of blocks has bits. From its entry, each block's task marks the parts' beginnings, and counts of these before it number them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import kept

#: Items of a block.
BLOCK = 1 << 16
#: A pointer is the block's number times PLACE, plus the item's place in it; END points behind the last item.
PLACE, END = 1 << 20, -1


def _blocks(items: DataFrame) -> DataFrame:
    """g, k (the block's number in its group), start (sum of sizes before it), total, blocks and whole (of its group), keys, sizes."""
    kinds = [items.schema[c].dataType for c in ("g", "key")]
    types = [to_arrow_type(kinds[0]), pa.int32(), pa.int64(), pa.int64(), pa.list_(to_arrow_type(kinds[1])), pa.list_(pa.int64())]
    names = ["g", "task", "seq", "total", "keys", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, own, held, n = TaskContext.get().partitionId(), 0, None, [], 0

        def taken() -> tuple:
            keys, sizes = (pa.chunked_array([x[c] for x in held]).combine_chunks() for c in (0, 1))
            return own, task, seq, pc.sum(sizes).as_py() or 0, keys.to_pylist(), sizes.to_pylist()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows, at = [], 0
            for end in pc.run_end_encode(batch.column(0)).run_ends.to_pylist() if batch.num_rows else []:
                g = batch.column(0)[at].as_py()
                if held and g != own:
                    rows.append(taken())
                    seq, held, n = seq + 1, [], 0
                own = g
                while at < end:
                    m = min(end - at, BLOCK - n)
                    held.append((batch.column(1).slice(at, m), batch.column(2).slice(at, m)))
                    at, n = at + m, n + m
                    if n == BLOCK:
                        rows.append(taken())
                        seq, held, n = seq + 1, [], 0
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([taken()])

    ordered = items.repartitionByRange("g", "key").sortWithinPartitions("g", "key")
    raw = ordered.mapInArrow(run, f"g {kinds[0].simpleString()}, task int, seq long, total long, keys array<{kinds[1].simpleString()}>, sizes array<long>")
    # as a struct, a null group equals itself
    raw = kept(raw.withColumn("g", F.struct("g")))
    # a row per block
    order = Window.partitionBy("g").orderBy("task", "seq")
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("g")
    places = raw.select("g", "task", "seq", (F.row_number().over(order) - 1).cast("long").alias("k"), before.alias("start"), F.count("*").over(whole).alias("blocks"), F.sum("total").over(whole).alias("whole"))
    return raw.join(places, ["g", "task", "seq"]).drop("task", "seq")


def _next(sizes: np.ndarray, budget: int, reached: bool) -> np.ndarray:
    """Of each item of a block, the place in the block of the item that begins the next part; the block's length if none does."""
    ends = np.cumsum(sizes)
    if reached:  # the part ends with the item that reaches the budget
        return np.searchsorted(ends, ends - sizes + budget, side="left") + 1
    return np.maximum(np.searchsorted(ends, ends - sizes + budget, side="right"), np.arange(len(sizes)) + 1)


def _pointers(large: DataFrame, budget: int, reached: bool) -> DataFrame:
    """(g, k, at): for each block, the pointer of each item to the first item of another block that begins a part."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, k, start, sizes, other, there, theirs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sizes, ends = np.array(sizes), there + np.cumsum(theirs)
                target = start + np.cumsum(sizes) - sizes + budget
                side = "left" if reached else "right"
                mine = np.flatnonzero((target > there if reached else target >= there) & (np.searchsorted(ends, target, side=side) < len(ends)))
                place = np.searchsorted(ends, target[mine], side=side) + reached
                if other == k:
                    place = np.maximum(place, mine + 1)
                code = np.where(place < len(ends), other * PLACE + place, (other + 1) * PLACE)
                if len(mine):
                    out.append((g, k, int(mine[0]), code))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema[0].type, pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["g", "k", "lo", "to"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, k, n, blocks, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                to = np.full(n, END, np.int64)
                for part in parts:
                    to[part["lo"] : part["lo"] + len(part["to"])] = part["to"]
                to[to >= blocks * PLACE] = END
                to = to.tolist()
                for i in range(n - 1, -1, -1):
                    if to[i] != END and to[i] // PLACE == k:
                        to[i] = to[to[i] % PLACE]
                out.append((g, k, to))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema[0].type, pa.int64(), pa.list_(pa.int64())), strict=True)], ["g", "k", "at"])

    width = F.greatest(F.lit(1.0), F.ceil(F.col("whole") / F.col("blocks")).cast("double"))
    slots = lambda lo: F.explode(F.sequence(F.floor(lo / F.col("width")), F.floor((lo + F.col("total")) / F.col("width"))))
    light = large.select("g", "k", "start", "total", width.alias("width"))
    asks = light.select("g", "k", "start", "total", slots(F.col("start") + budget).alias("slot"))
    gives = light.select("g", F.col("k").alias("other"), F.col("start").alias("there"), F.col("total").alias("theirs"), slots(F.col("start")).alias("slot"))
    meet = (F.col("start") + budget <= F.col("there") + F.col("theirs")) & (F.col("start") + F.col("total") + budget >= F.col("there")) & (F.col("other") >= F.col("k"))
    pairs = asks.join(gives, ["g", "slot"]).filter(meet).select("g", "k", "other").distinct()
    pairs = pairs.join(large.select("g", "k", "start", "sizes"), ["g", "k"]).join(large.select("g", F.col("k").alias("other"), F.col("start").alias("there"), F.col("sizes").alias("theirs")), ["g", "other"])
    kind = large.schema["g"].dataType.simpleString()
    to = pairs.select("g", "k", "start", "sizes", "other", "there", "theirs").mapInArrow(found, f"g {kind}, k long, lo long, to array<long>")
    # the pointers of one block's items, at most BLOCK of them
    own = to.groupBy("g", "k").agg(F.collect_list(F.struct("lo", "to")).alias("parts"))
    all_own = large.select("g", "k", F.size("sizes").alias("n"), "blocks").join(own, ["g", "k"], "left").select("g", "k", "n", "blocks", F.coalesce("parts", F.array().cast("array<struct<lo:bigint,to:array<bigint>>>")).alias("parts"))
    return all_own.mapInArrow(followed, f"g {kind}, k long, at array<long>")


def _entries(large: DataFrame, budget: int, reached: bool, blocks: int) -> DataFrame:
    """(g, k, entry): the first item of block k that begins a part, for all blocks in which one begins; no group has more than
    `blocks` of them."""
    pointers = kept(_pointers(large, budget, reached))
    asked = pointers.select("g", F.explode(F.array_distinct("at")).alias("code")).filter(F.col("code") != END)
    first = pointers.select("g", F.lit(0).cast("long").alias("code")).distinct()
    asked = asked.unionByName(first).distinct().groupBy("g", F.floor(F.col("code") / PLACE).alias("k")).agg(F.collect_list("code").alias("codes"))
    known = asked.join(pointers, ["g", "k"]).select("g", F.explode(F.transform("codes", lambda c: F.struct(c.alias("code"), F.get("at", (c % PLACE).cast("int")).alias("to")))).alias("x")).select("g", "x.code", "x.to")
    jumps, at = kept(known.filter(F.col("to") != END)), kept(first)
    for _ in range(blocks.bit_length()):
        at = kept(at.unionByName(at.join(jumps, ["g", "code"]).select("g", F.col("to").alias("code"))))
        on = jumps.select("g", F.col("code").alias("to"), F.col("to").alias("then"))
        jumps = kept(jumps.join(on, ["g", "to"]).select("g", "code", F.col("then").alias("to")))
    return at.select("g", F.floor(F.col("code") / PLACE).alias("k"), (F.col("code") % PLACE).alias("entry"))


def numbered(items: DataFrame, group: str | None, order: str, size: str, budget: int, *, reached: bool = False) -> DataFrame:
    """group, order, part: the number of each item's part in its group, from 0.

    A part ends before the item with which its sizes would pass the budget; with `reached`, it ends with the item with which
    they reach it. An item above the budget is a part of its own. Sizes are whole numbers; null or negative ones count as zero.
    Within a group, the values of `order` differ. group: None for one group of all items, which the result then doesn't name.
    """
    if budget <= 0:
        raise ValueError("the budget has to be positive")
    n = F.least(F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)), F.lit(budget + 1)).cast("long")
    own = items.select((F.lit(0) if group is None else F.col(group)).alias("g"), F.col(order).alias("key"), n.alias("n"))
    blocks = kept(_blocks(own))
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    begun = blocks.withColumn("entry", F.when(F.col("blocks") == 1, F.lit(0).cast("long")))
    if most > 1:
        entries = _entries(blocks.filter("blocks > 1"), budget, reached, most).withColumnRenamed("entry", "found")
        begun = begun.join(entries, ["g", "k"], "left").withColumn("entry", F.coalesce("entry", "found"))
    begun = begun.select("g", "k", "entry", "keys", "sizes")
    types = [to_arrow_type(blocks.schema["g"].dataType), pa.int64(), to_arrow_type(blocks.schema["keys"].dataType), pa.list_(pa.int64()), pa.int64()]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, parts = [], []
            for entry, sizes in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                sizes = np.array(sizes.values)
                begins = np.zeros(len(sizes), np.int64)
                if entry is not None:
                    to, at = _next(sizes, budget, reached).tolist(), entry
                    while at < len(sizes):
                        begins[at], at = 1, to[at]
                parts.append(np.cumsum(begins))
                counts.append(int(begins.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(parts, types[3]), pa.array(counts, types[4])], ["g", "k", "keys", "parts", "begun"])

    kind = {c: blocks.schema[c].dataType.simpleString() for c in ("g", "keys")}
    out = begun.mapInArrow(marked, f"g {kind['g']}, k long, keys {kind['keys']}, parts array<long>, begun long")
    names = [] if group is None else [F.col("g.g").alias(group)]
    if most == 1:
        return out.select("g", F.explode(F.arrays_zip("keys", "parts")).alias("x")).select(*names, F.col("x.keys").alias(order), (F.col("x.parts") - 1).cast("int").alias("part"))
    out = kept(out)
    before = F.coalesce(F.sum("begun").over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = out.select("g", "k", (before - 1).alias("base"))
    each = out.join(bases, ["g", "k"]).select("g", "base", F.explode(F.arrays_zip("keys", "parts")).alias("x"))
    return each.select(*names, F.col("x.keys").alias(order), (F.col("base") + F.col("x.parts")).cast("int").alias("part"))
