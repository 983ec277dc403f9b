"""Correlation over streams: event counts in sliding windows or up to each event, bursts as sessions, one event after
another by state.

Events need `ts` (timestamp) and group keys; rows without either can't enter windowed state and are
for a batch path (split_untimed). Late rows beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import audit
from ..operators.correlation import seconds


def split_untimed(events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can be correlated, and the rest."""
    whole = F.col("ts").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return events.filter(whole), events.filter(~whole)


def _late_test(hit: Column) -> Column:
    """hit, in a form that isn't moved below the watermark, so that other events advance the watermark too."""
    return F.when(F.col("ts").isNotNull(), hit)


def event_counts(events: DataFrame, hit: Column, keys: list[str], timespan: str, least: int, *, slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows of a timespan, one per slide, in which a group has at least `least` matching events."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).filter(_late_test(hit))
    counted = own.groupBy(F.window("ts", f"{seconds(timespan)} seconds", slide), *keys).agg(F.count(F.lit(1)).alias("match_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return counted.filter(F.col("match_count") >= least).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "match_count", "first_ts", "last_ts")


def bursts(events: DataFrame, hit: Column, keys: list[str], gap: str, least: int, *, late: str = "10 minutes") -> DataFrame:
    """Sessions of matching events no further apart than the gap, with at least `least` of them."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).filter(_late_test(hit))
    counted = own.groupBy(F.session_window("ts", f"{seconds(gap)} seconds").alias("session"), *keys).agg(F.count(F.lit(1)).alias("match_count"))
    return counted.filter(F.col("match_count") >= least).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *keys, "match_count")


def _time_mode(forget_ms: int | None) -> str:
    """State that goes by the clock needs a query that runs on; others end when all input is read."""
    return "ProcessingTime" if forget_ms else "none"


class _Counted(StatefulProcessor):
    """Keeps the times of a group's matches within the timespan before its latest one."""

    def __init__(self, span: int, least: int, late: int, out: list[str], forget: int | None) -> None:
        self.span, self.least, self.late, self.out, self.forget = span, least, late, out, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "raw binary", self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["s", "event_id"], kind="stable")
        new = pdf["s"].to_numpy(float)
        old = np.frombuffer(bytes(self.times.get()[0]), float) if self.times.exists() else np.zeros(0)
        times = np.sort(np.concatenate([old, new]))
        counts = np.searchsorted(times, new, "right") - np.searchsorted(times, new - self.span, "left")
        self.times.update((times[times >= times[-1] - self.span - self.late].tobytes(),))
        hit = counts >= self.least
        columns = [[str(k)] * int(hit.sum()) for k in key] + [pdf["event_id"].to_numpy()[hit], new[hit], counts[hit]]
        yield pd.DataFrame(list(zip(*columns, strict=True)), columns=self.out)

    def close(self) -> None:
        pass


class _Ordered(StatefulProcessor):
    """Keeps the latest time of the first event per group: one number of state each."""

    def __init__(self, span: int, out: list[str], forget: int | None) -> None:
        self.span, self.out, self.forget = span, out, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double", self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["s", "event_id"], kind="stable")
        s, first = pdf["s"].to_numpy(float), pdf["first"].to_numpy(bool)
        held = self.last.get()[0] if self.last.exists() else -np.inf
        seen = np.maximum.accumulate(np.r_[held, np.where(first, s, -np.inf)])  # before each row, and after the last
        hit = pdf["then"].to_numpy(bool) & (s - seen[:-1] <= self.span) & (s >= seen[:-1])
        if np.isfinite(seen[-1]):
            self.last.update((float(seen[-1]),))
        columns = [[str(k)] * int(hit.sum()) for k in key] + [pdf["event_id"].to_numpy()[hit], s[hit], seen[:-1][hit]]
        yield pd.DataFrame(list(zip(*columns, strict=True)), columns=self.out)

    def close(self) -> None:
        pass


def trailing_counts(events: DataFrame, hit: Column, keys: list[str], timespan: str, least: int, *, late: str = "10m", forget_ms: int | None = None) -> DataFrame:
    """Matching events at which the matches of their group within the trailing timespan reach `least`, as the batch form
    finds them: keys (as text), event_id, s (epoch seconds), match_count. Windows of event_counts() lie on a grid, so a
    burst may fit the timespan but none of them; here the timespan ends at each event.

    An event counts for those that come after it; one that comes late, but by no more than `late`, counts those before
    it, and the counts of later events that are out already aren't given again. forget_ms: the state of a group that gets
    no event for so long (by the clock) goes; give it to queries that run on, not to those that end with their input.
    Needs the RocksDB state store.
    """
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(hit & F.col("ts").isNotNull())
    own = own.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("double").alias("s"))
    out = [*keys, "event_id", "s", "match_count"]
    schema = ", ".join([*[f"{k} string" for k in keys], "event_id long, s double, match_count long"])
    processor = _Counted(seconds(timespan), least, seconds(late), out, forget_ms)
    return own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=_time_mode(forget_ms))


def temporal_ordered(events: DataFrame, first: Column, then: Column, keys: list[str], timespan: str, *, late: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """Events where `then` holds within a timespan after an event of the group where `first` held: keys (as text),
    event_id, s (epoch seconds), first_s. forget_ms: as for trailing_counts(). Needs the RocksDB state store."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = own.withColumns({"first": first, "then": then, "s": F.col("ts").cast("double")}).filter("first or then")
    own = own.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("event_id").cast("long").alias("event_id"), "s", "first", "then", "ts")
    out = [*keys, "event_id", "s", "first_s"]
    schema = ", ".join([*[f"{k} string" for k in keys], "event_id long, s double, first_s double"])
    processor = _Ordered(seconds(timespan), out, forget_ms)
    return own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=_time_mode(forget_ms))


def append_chain(batches: DataFrame, path: str, seq: int = 0, prev_hash: str = audit.GENESIS):
    """A foreachBatch function that appends rows to a hash-chained log by its single writer, from seq and prev_hash on.

    Each batch has a folder for its entries and one for the head it leaves, both overwritten if the batch is run again, and
    a batch goes on from the head that the one before it left: neither a replay nor a restart doubles or forks the
    chain. Batches are small: they are appended in order on the driver.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        head = {"seq": seq, "prev_hash": prev_hash}
        if batch_id > 0:
            head = spark.read.schema("seq long, prev_hash string").json(f"{path}/head/batch={batch_id - 1}").first().asDict()
        rows = [r.asDict() for r in batch.orderBy("timestamp").toLocalIterator()]
        entries = audit.append(rows, **head)
        if entries:
            head = {"seq": entries[-1]["seq"] + 1, "prev_hash": entries[-1]["entry_hash"]}
            spark.createDataFrame(entries).write.mode("overwrite").json(f"{path}/entries/batch={batch_id}")
        spark.createDataFrame([(head["seq"], head["prev_hash"])], "seq long, prev_hash string").coalesce(1).write.mode("overwrite").json(f"{path}/head/batch={batch_id}")

    return batches.writeStream.foreachBatch(write)
