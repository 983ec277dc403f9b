import pytest
from pyspark.sql import functions as F

from emberwatch.operators import correlation
from emberwatch.streaming import correlation as streaming


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition of a stateful query is a store and a process of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = [(i, 60 * i, "k", "bad" if i < 6 else "good") for i in range(8)] + [(50, 0, "q", "bad"), (51, 30, None, "bad"), (99, 50_000, "z", "none")]
    df = spark.createDataFrame(rows, "event_id long, s long, src_ip string, message string").withColumn("ts", F.timestamp_seconds("s"))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(df.schema).parquet(path)


def run(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_counts_and_bursts(spark, events, tmp_path):
    _, stream = events
    timed, rest = streaming.split_untimed(stream, ["src_ip"])
    assert rest.isStreaming
    got = run(spark, streaming.event_counts(timed, F.col("message") == "bad", ["src_ip"], "5m", 5), "counts", tmp_path)
    assert {r["src_ip"] for r in got.collect()} == {"k"} and got.agg(F.max("match_count")).first()[0] == 5
    sessions = run(spark, streaming.bursts(timed, F.col("message") == "bad", ["src_ip"], "2m", 3), "bursts", tmp_path)
    assert [r["match_count"] for r in sessions.collect()] == [6]


def test_ordered_like_batch(spark, events, tmp_path):
    batch, stream = events
    bad, good = F.col("message") == "bad", F.col("message") == "good"
    want = {(r["event_id"], r["first_ts"]) for r in correlation.temporal_ordered(batch, bad, good, ["src_ip"], "90s").collect()}
    assert want == {(6, 300.0)}
    timed, _ = streaming.split_untimed(stream, ["src_ip"])
    got = run(spark, streaming.temporal_ordered(timed, bad, good, ["src_ip"], "90s"), "ordered", tmp_path)
    assert {(r["event_id"], r["first_s"]) for r in got.collect()} == want


def test_trailing_counts_like_batch(spark, events, tmp_path):
    """A burst that fits the timespan but no window of the grid is found, over several batches of the stream."""
    path = str(tmp_path / "many")
    rows = [(i, 30 + 74 * i, "k") for i in range(5)] + [(10 + i, 1000 + 100 * i, "k") for i in range(4)] + [(20 + i, 50, "q") for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, s long, src_ip string").withColumn("ts", F.timestamp_seconds("s"))
    for part in (F.col("s") < 200, F.col("s") >= 200):  # files in order of time
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    want = {(r["event_id"], r["match_count"]) for r in correlation.event_count(batch, F.lit(True), ["src_ip"], "5m", 4).collect()}
    assert (4, 5) in want
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(spark, streaming.trailing_counts(stream, F.lit(True), ["src_ip"], "5m", 4), "trailing", tmp_path)
    assert {(r["event_id"], r["match_count"]) for r in got.collect()} == want


def test_chain_survives_replay_and_restart(spark, tmp_path):
    from emberwatch.operators import audit

    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = lambda k: spark.createDataFrame([(f"2026-01-0{k}T00:0{i}:00Z", f"a{i}") for i in range(3)], "timestamp string, actor string")
    rows(1).coalesce(1).write.mode("append").parquet(path)

    def once():
        stream = spark.readStream.schema("timestamp string, actor string").option("maxFilesPerTrigger", 1).parquet(path)
        q = streaming.append_chain(stream, log).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    once()
    rows(2).coalesce(1).write.mode("append").parquet(path)
    once()  # a restart goes on with the chain
    held = {}
    streaming.append_chain(type("B", (), {"writeStream": type("W", (), {"foreachBatch": lambda self, f: held.update(f=f)})()})(), log)
    held["f"](spark.read.parquet(path).filter("timestamp >= '2026-01-02'"), 1)  # the last batch again
    entries = spark.read.json(f"{log}/entries")
    assert entries.count() == 6 and entries.select("seq").distinct().count() == 6
    assert audit.report(entries.drop("batch")).first()["intact"]
