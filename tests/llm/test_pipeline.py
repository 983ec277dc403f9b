import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from emberwatch.llm import decontam, packing, quality, queries

DATA = "/root/testdata/sf0.001"


def test_names():
    have = queries.QUERIES
    assert [next(n for n in have if n.startswith(f"op{k}_")) for k in range(1, 11)]
    assert "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(have)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontaminate", "remove_pii", "pack"]


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{path}/{name}")
        out.append(spark.read.parquet(f"{path}/{name}"))
    return out


def test_stages_keep_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_each_stage_by_brute_force(spark, stages):
    """Every decision, taken again from the operators' plain parts."""
    start, good, single, clean, safe, packed = [df.toPandas() for df in stages]
    model = queries.quality_model(spark, DATA)
    known = {w: k + quality.OTHER for k, w in enumerate(model.words)}
    scores = quality.score_texts(start["text"].tolist(), model, known)
    assert set(good["doc_id"]) == set(start["doc_id"][scores >= 0.3])
    sets = [shingles(t) for t in good["text"]]
    ids = good["doc_id"].tolist()
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(ids[i]), find(ids[j])
                up[max(a, b)] = min(a, b)
    assert set(single["doc_id"]) == {find(i) for i in ids}
    index = decontam.Index([tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()])
    assert set(clean["doc_id"]) == {i for i, t in zip(single["doc_id"], single["text"], strict=True) if not index.matches(t)}
    assert set(safe["doc_id"]) == set(clean["doc_id"]) and not safe["text"].str.contains("@mail").any()
    total = packed.groupby("doc_id")["length"].sum()
    assert set(total.index) == set(safe["doc_id"]) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_run_over_a_small_folder(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def test_sequences_are_balanced(spark, stages):
    """The documents and the attention that a sequence may have select sequences in the pipeline, and cost few more."""
    rows, limits = stages[-1].toPandas(), packing.BALANCED
    own = rows.assign(cost=rows["length"] ** 2).groupby("sequence_id").agg(n=("length", "size"), tokens=("length", "sum"), cost=("cost", "sum"))
    assert (own["n"] <= limits.documents).all() and (own["tokens"] <= 2048).all()
    assert ((own["cost"] <= limits.attention) | (own["n"] == 1)).all()
    plain = packing.pack(stages[-1].drop("sequence_id", "offset")).toPandas()
    most = plain.assign(cost=plain["length"] ** 2).groupby("sequence_id").agg(n=("length", "size"), cost=("cost", "sum"))
    assert ((most["n"] > limits.documents) | ((most["cost"] > limits.attention) & (most["n"] > 1))).any()
    assert len(own) <= 1.05 * len(most) + 2


NAMES = ["d", "t", "n", "m", "__d", "__t", "__m", "hit", "__hit0", "score", "__score", "shard", "key", "nid", "fp", "terms", "words", "A.b c"]


def test_stages_keep_columns_of_any_name(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumns({c: F.lit(c) for c in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns and all(r[c] == c for r in out.select(*[f"`{c}`" for c in NAMES]).collect() for c in r.asDict()), name
        assert stage(spark, rows.filter("false"), DATA).count() == 0
    assert corpus_pipeline.pack(spark, rows, DATA).count() >= 40


def test_null_and_repeated_rows_in_every_stage(spark):
    """Null ids and texts, empty texts and repeated rows go through every stage; none but copies is lost."""
    long = "word " * 30_000
    text = "The quick harbour master wrote long letters about ships, weather and trade to friends in distant towns."
    rows = spark.createDataFrame([(1, None), (None, None), (2, ""), (3, text), (3, text), (None, text), (4, long)], "doc_id long, text string")
    rows = rows.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in stage(spark, rows, DATA).collect()) == [1, 3, 4]
        elif name != "quality_filter":
            assert stage(spark, rows, DATA).count() >= 7, name
        else:
            assert stage(spark, rows, DATA).count() <= 7
