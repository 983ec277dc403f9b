"""Canonical JSON against json.dumps, ids against uuid, and a chain of approvals."""

import hashlib
import json
import random
import uuid

from pyspark.sql import functions as F

from emberwatch.functions import canonical
from emberwatch.operators import audit


def plain(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_canonical_as_json_dumps(spark):
    rng = random.Random(3)
    letters = 'abz09 "\\/\b\f\n\r\t\x01\x1f\x7f\x80éßΩ中  ￮\U0001f600\U00010000{}[]:,.'

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 2:
            return "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        if kind < 6:
            return [rng.randrange(-(10**18), 10**18), rng.choice([-1, 1]) * round(rng.uniform(1, 1000), rng.randrange(1, 6)), rng.choice([True, False, None]), rng.choice([0.0, -0.0, 1.5, 100.0, 0.0001])][kind - 2]
        if kind == 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {"".join(rng.choice(letters[:-12] + "äö") for _ in range(rng.randrange(4))): value(depth - 1) for _ in range(rng.randrange(5))}

    values = [{"k": value(3), "a": value(2)} for _ in range(300)] + ['"', "\\", "", {}, [], 0, "\\u0041", {"a.1e5": "1.50"}, 123456789012345678901234567890]
    texts = [f(v) for v in values for f in (json.dumps, lambda v: json.dumps(v, ensure_ascii=False, indent=1))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical.canonical(F.col("t")).alias("c")).collect()
    found = {r["i"]: r["c"] for r in rows}
    missing = 0
    for i, t in enumerate(texts):
        if found[i] is None:
            missing += 1
            assert "￮" in t or "ffee" in t
        else:
            assert found[i] == plain(json.loads(t)), t
    assert missing < len(texts) / 2


def test_what_cannot_be_told_is_null(spark):
    texts = ['{"a":1,"a":2}', '{"a":"\\ud800"}', '{"a":"\\udc00x"}', '{"a":1e5}', '{"a":0.00001}', '{"a":1.2345678901234567}', "{", None, '{"\U0001f600":1,"￮":2}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [None] * len(texts)


def test_long_texts(spark):
    """A payload of two million characters, half of them escapes."""
    value = {"note": 'ü"\\\n' * 500_000, "n": [1.5] * 1000}
    row = spark.createDataFrame([(json.dumps(value),)], "t string").select(canonical.canonical(F.col("t")).alias("c")).first()
    assert row["c"] == plain(value)


def test_quoted_and_uuid5(spark):
    texts = ["", "a", 'q"\\', "Überprüfung \U0001f600", "\x00\x7f\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical.quoted(F.col("t")).alias("q"), canonical.uuid5(uuid.NAMESPACE_URL, F.col("t")).alias("u")).collect()
    for r in rows:
        assert r["q"] == json.dumps(r["t"])
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["t"]))


def test_chain_of_approvals(spark):
    payloads = [{"note": "Überprüfung ok"}, {"b": 0.95, "a": "\U0001f600"}, {"x": 1}, {"x": 2}]
    prev, rows = "sha256:0", []
    for line, p in enumerate(payloads, 1):
        own = "sha256:" + hashlib.sha256(plain({"decision_id": f"dé{line}", "payload": p, "prev": prev}).encode()).hexdigest()
        rows.append((line, f"dé{line}", json.dumps(p, ensure_ascii=False), prev, own))
        prev = own
    schema = "line int, decision_id string, payload string, prev_hash string, record_hash string"

    def problems():
        return [r["problem"] for r in audit.queue_problems(spark.createDataFrame(rows, schema), "sha256:0").orderBy("line").collect()]

    assert problems() == [None] * 4
    rows[1] = (*rows[1][:2], '{"a": "other", "b": 0.95}', *rows[1][3:])
    rows[2] = (*rows[2][:2], '{"x": 1e3}', *rows[2][3:])
    rows[3] = (*rows[3][:2], "nothing", *rows[3][3:])
    assert problems() == [None, "hash mismatch", "not checked", "malformed"]
