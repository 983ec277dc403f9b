"""Numbered lines and tails of files against plain reads."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import audit, compliance
from emberwatch.sources import lines, readers


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1000")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_one_file_in_many_ranges(spark, tmp_path, small_ranges, monkeypatch):
    rng = random.Random(5)
    ends = ["\n", "\r\n", "\r", "\n\n", " \n\t\n"]
    text = "".join(rng.choice(["", "x", "é" * rng.randrange(40), " a b ", "y" * rng.randrange(3000)]) + rng.choice(ends) for _ in range(2000)) + "last"
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.log").write_bytes(b"")
    plain = [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    for most in (lines.MOST_RANGES, 1):
        monkeypatch.setattr(lines, "MOST_RANGES", most)
        got = lines.numbered_lines(spark, str(tmp_path))
        assert got.count() == 2 * len(plain)
        for name in ("a.log", "b.log"):
            own = got.filter(F.col("file").endswith(name)).orderBy("idx").collect()
            assert [(r["idx"], r["raw"]) for r in own] == list(enumerate(plain))
    assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 20
    assert readers.log_lines(spark, str(tmp_path), 3).count() == 6


def test_blank_lines_counted(spark, tmp_path, small_ranges):
    text = "".join(f"{'' if i % 3 == 0 else i}\n" for i in range(3000))
    (tmp_path / "log.1").write_text(text)
    (tmp_path / "log").write_text("z\n")
    got = audit.segments(spark, str(tmp_path)).orderBy("file_order", "line").collect()
    assert [tuple(r) for r in got] == [(-1, i, str(i)) for i in range(3000) if i % 3] + [(0, 0, "z")]


def test_tail(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    assert lines.tail_lines(spark, str(folder)).count() == 0
    own = [f"line {i} é" for i in range(1000)]
    (folder / "a").write_text("\n".join(own) + "\n")
    size = (folder / "a").stat().st_size
    assert [r["raw"] for r in lines.tail_lines(spark, str(folder)).collect()] == own
    for most in (1, 11, 12, 13, 14, 500, size - 1, size, size + 1):
        data = (folder / "a").read_bytes()
        cut = data[-most:] if most < size else data
        whole = most >= size or data[-most - 1 : -most] == b"\n"
        expected = [x for x in (cut if whole else cut.partition(b"\n")[2]).decode().split("\n") if x]
        assert [r["raw"] for r in lines.tail_lines(spark, str(folder / "a"), most).collect()] == expected, most
    with pytest.raises(ValueError):
        lines.tail_lines(spark, str(folder), 0)


def test_tail_of_evidence(spark, tmp_path):
    rows = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("m", "manual")], "control_id string, status string")
    for day in range(1, 5):
        compliance.record_run(rows.coalesce(1), str(tmp_path / "e"), f"2026-01-0{day}")
    newest = compliance.load_evidence(spark, str(tmp_path / "e"), 4).collect()
    assert [(r["recorded_at"], r["control_id"]) for r in newest] == [("2026-01-04", "a"), ("2026-01-04", "b"), ("2026-01-04", "m"), ("2026-01-03", "a")]
    with pytest.raises(ValueError):
        compliance.load_evidence(spark, str(tmp_path / "e"), 0)
    said = compliance.run_summary(rows, "2026-01-05").first()
    assert tuple(said) == ("2026-01-05", "compliance-engine", "compliance_run", "read_only", "attention", "1/2 automated controls passing")
    assert compliance.run_summary(rows.filter("status = 'pass'"), "x").first()["decision"] == "pass"


def test_broken_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n{"a": 3\n')
    assert [r["a"] for r in readers.jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1, 2]
    assert [r["n"] for r in readers.broken_lines(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [2]
