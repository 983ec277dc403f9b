"""Hash-chained logs: verification in parallel, where it first breaks, and production.

An entry's hash covers its own fields and the hash before it, so checking needs only each row and its
predecessor. Rows are numbered by sequence, and a row meets its predecessor by a join on that number:
the whole log is never one window partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical, quoted
from ..sources.lines import numbered_lines
from .budget import numbered

GENESIS = "0" * 64
FIELDS = ["seq", "timestamp", "actor", "action", "action_class", "decision", "reason", "prev_hash"]


def entry_hash(fields: list[str] = FIELDS) -> Column:
    """SHA-256 over the fields joined by bars; null fields count as empty, so that none is skipped."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).cast("binary"), 256)


def hmac(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text in UTF-8, as lower-case hex: two native hashes, RFC 2104."""
    if not key:
        raise ValueError("an empty key")
    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in own)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def head_signature(key: bytes, seq: str = "head_seq", head: str = "head_hash") -> Column:
    """Signature over the head of a chain: its sequence number and hash, joined by a bar."""
    return hmac(F.concat_ws("|", F.col(seq).cast("string"), head), key)


def rotated(entries: DataFrame, max_bytes: int, size: str = "size") -> DataFrame:
    """entries (seq, size in bytes) with segment, from 0: as by a writer that looks at its file before each append and, once it
    has reached max_bytes, begins a new one at zero. seq doesn't repeat."""
    if max_bytes <= 0:
        raise ValueError("max_bytes has to be positive")
    own = numbered(entries, None, "seq", size, max_bytes, reached=True)
    return entries.join(own.select("seq", F.col("part").cast("long").alias("segment")), "seq")


def retained(entries: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The entries (seq, entry_hash, segment) of the newest segment and the `keep` before it, and the checkpoint.

    The checkpoint has one row: seq and entry_hash of the newest entry that goes (null if none does). What is kept is
    checked with first_seq one above it and its hash as genesis.
    """
    if keep < 0:
        raise ValueError("keep can't be negative")
    numbers = entries.select("segment").distinct()
    archives = numbers.orderBy(F.desc("segment")).limit(keep + 1).agg(F.min("segment").alias("__oldest"))
    marked = entries.crossJoin(F.broadcast(archives))  # one row beside
    kept = marked.filter(F.col("segment") >= F.col("__oldest")).drop("__oldest")
    cut = marked.filter(F.col("segment") < F.col("__oldest")).agg(F.max(F.struct("seq", "entry_hash")).alias("m"))
    return kept, cut.select(F.col("m.seq").alias("seq"), F.col("m.entry_hash").alias("entry_hash"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """file_order, line, value of a log's files: numbered (oldest, the highest number, first), then the active one; line is the
    place in its file, whatever its size."""
    lines = numbered_lines(spark, path, blank=True)
    number = F.regexp_extract("file", r"\.(\d+)$", 1).try_cast("long")
    return lines.filter(F.length(F.trim("raw")) > 0).select((-F.coalesce(number, F.lit(0))).alias("file_order"), F.col("idx").alias("line"), F.col("raw").alias("value"))


def parsed(lines: DataFrame) -> DataFrame:
    """lines with the entry's fields; malformed is true where one is missing."""
    schema = ", ".join(f"{f} {'long' if f == 'seq' else 'string'}" for f in [*FIELDS, "entry_hash"])
    own = lines.withColumn("r", F.from_json("value", schema)).select(*lines.columns, "r.*")
    gone = [F.col(f).isNull() for f in [*FIELDS, "entry_hash"]]
    bad = gone[0]
    for g in gone[1:]:
        bad = bad | g
    return own.withColumn("malformed", bad)


def checked(entries: DataFrame, *, first_seq: int = 0, genesis: str = GENESIS, fields: list[str] = FIELDS) -> DataFrame:
    """entries (the fields, entry_hash) with problem: hash mismatch, repeated seq, gap, chain break, or null.

    An entry's predecessor is the entry with the sequence number before; the first follows genesis.
    """
    own = entries.withColumn("__hash", entry_hash(fields))
    before = own.groupBy((F.col("seq") + 1).alias("__next")).agg(F.min("entry_hash").alias("__before"), F.count(F.lit(1)).alias("__n"))
    same = own.groupBy(F.col("seq").alias("__seq")).agg(F.count(F.lit(1)).alias("__same"))
    out = own.join(before, own["seq"] == before["__next"], "left").join(same, own["seq"] == same["__seq"], "left")
    start = F.col("seq") == first_seq
    problem = (
        F.when(F.col("__hash") != F.col("entry_hash"), "hash mismatch")
        .when(F.col("__same") > 1, "repeated seq")
        .when(~start & F.col("__before").isNull(), "gap")
        .when(F.when(start, F.lit(genesis)).otherwise(F.col("__before")) != F.col("prev_hash"), "chain break")
    )
    return out.withColumn("problem", problem).drop("__hash", "__next", "__before", "__n", "__seq", "__same")


def report(entries: DataFrame, **how) -> DataFrame:
    """One row: entries, head_seq, head_hash, first_bad_seq, problem, intact."""
    own = checked(entries, **how)
    out = own.agg(
        F.count(F.lit(1)).alias("entries"),
        F.max("seq").alias("head_seq"),
        F.max_by("entry_hash", "seq").alias("head_hash"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("seq", "problem"))).alias("bad"),
    )
    return out.select("entries", "head_seq", "head_hash", F.col("bad.seq").alias("first_bad_seq"), F.col("bad.problem").alias("problem"), F.col("bad").isNull().alias("intact"))


def append(rows: Iterable[dict], *, seq: int = 0, prev_hash: str = GENESIS) -> list[dict]:
    """Entries for rows, one after another: producing a chain is sequential, and done by its single writer."""
    out = []
    for row in rows:
        own = {f: str(row.get(f, "")) for f in FIELDS[1:-1]}
        entry = {"seq": seq, **own, "prev_hash": prev_hash}
        prev_hash = hashlib.sha256("|".join(str(entry[f]) for f in FIELDS).encode()).hexdigest()
        out.append(entry | {"entry_hash": prev_hash})
        seq += 1
    return out


def pending(records: DataFrame) -> DataFrame:
    """Approvals submitted but not resolved, from records (line, kind, ref, payload): the last payload of each ref."""
    last = records.filter("kind = 'submitted'").groupBy("ref").agg(F.max(F.struct("line", "payload")).alias("m")).select("ref", "m.line", "m.payload")
    return last.join(records.filter("kind = 'resolved'").select("ref").distinct(), "ref", "left_anti")


def queue_counts(records: DataFrame) -> DataFrame:
    """records, resolved and consumed (distinct refs), pending; one row."""
    kinds = records.groupBy("ref").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("submitted", "resolved", "consumed")], F.count(F.lit(1)).alias("n"))
    return kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count_if("resolved").alias("resolved"),
        F.count_if("consumed").alias("consumed"),
        F.count_if(F.col("submitted") & ~F.col("resolved")).alias("pending"),
    )


def queue_text() -> Column:
    """Canonical JSON of an approval record: decision_id, payload (JSON text) and prev_hash; null where the payload's canonical
    form can't be told (see canonical)."""
    return F.concat(F.lit('{"decision_id":'), quoted(F.col("decision_id")), F.lit(',"payload":'), canonical(F.col("payload")), F.lit(',"prev":'), quoted(F.col("prev_hash")), F.lit("}"))


def queue_digest() -> Column:
    """Hash of an approval record's canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(queue_text().cast("binary"), 256))


def queue_problems(records: DataFrame, genesis: str) -> DataFrame:
    """records (line from 1, decision_id, payload, prev_hash, record_hash) with problem: chain break, malformed (the payload is
    no JSON object), not checked (no digest can be told), hash mismatch, or null."""
    before = records.select((F.col("line") + 1).alias("__line"), F.col("record_hash").alias("__before"))
    out = records.join(before, F.col("line") == F.col("__line"), "left")
    expected = F.when(F.col("line") == 1, F.lit(genesis)).otherwise(F.col("__before"))
    problem = F.when(~F.col("prev_hash").eqNullSafe(expected), "chain break").when(F.json_object_keys("payload").isNull(), "malformed")
    problem = problem.when(F.col("__digest").isNull(), "not checked").when(~F.col("__digest").eqNullSafe(F.col("record_hash")), "hash mismatch")
    return out.withColumn("__digest", queue_digest()).withColumn("problem", problem).drop("__line", "__before", "__digest")
