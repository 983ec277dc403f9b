"""A stored index against retrieval over all chunks."""

import random

from emberwatch.operators import postings, retrieval


def corpus(spark, rng, n, first=0):
    words = [f"w{i:03d}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = [(f"s{i // 3 + first}", i % 3, " ".join(rng.choices(words, weights, k=rng.randrange(1, 30)))) for i in range(n)]
    return spark.createDataFrame(rows, "source string, index int, text string")


def test_as_over_all_chunks(spark, tmp_path):
    rng = random.Random(7)
    loads = [corpus(spark, rng, 600), corpus(spark, rng, 300, 1000)]
    path = str(tmp_path / "i")
    asked = [(i, " ".join(f"w{min(199, int(rng.expovariate(0.03))):03d}" for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    asked += [(90, "w000 w001 w002 w150"), (91, "nothing known"), (92, ""), (93, None), (94, "w000")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    held = None
    for load in loads:
        postings.append(load, path)
        held = load if held is None else held.unionByName(load)
        for k in (1, 3, 1000):
            expected = {tuple(r) for r in retrieval.retrieve(held, queries, k).collect()}
            assert {tuple(r) for r in postings.retrieve(spark, path, queries, k).collect()} == expected


def test_frequent_terms_bring_in_nothing(spark, tmp_path):
    """Of a frequent term beside a rare one only the chunks of the rare one are scored."""
    rows = [(f"s{i}", 0, "common " + ("rare" if i % 100 == 0 else "filler")) for i in range(1000)]
    path = str(tmp_path / "i")
    postings.append(spark.createDataFrame(rows, "source string, index int, text string"), path)
    queries = spark.createDataFrame([(1, "common rare")], "query_id int, query string")
    assert postings.scores(spark, path, queries).count() == 10
    read = postings._of(spark, path, spark.createDataFrame([(1, "rare")], "query_id int, term string"))
    assert read.count() == 10 and "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    postings.append(spark.createDataFrame([], "source string, index int, text string"), path)
    queries = spark.createDataFrame([(1, "common rare")], "query_id int, query string")
    assert postings.retrieve(spark, path, queries).count() == 0
