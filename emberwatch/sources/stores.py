"""Stores of rules, intelligence, policies and pins, from files that any Spark path names.

Such files are few and small, which is checked before their texts are taken to the driver. A store is taken whole or,
at any fault, not at all (ValueError); only single rule files that can't be read are left out.
"""

from __future__ import annotations

import json
import re
import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intel, mapping
from ..operators.policy import CLASS_WORDS

MOST_FILES, MOST_BYTES = 500, 1 << 19
DECISIONS = ("allow", "require_approval", "deny")
ATTESTATION = {"control_id", "date", "expires", "attested_by", "statement"}
HEX = re.compile("[0-9a-f]{64}")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def texts(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST_BYTES) -> list[tuple[str, str]]:
    """(name, text) of a folder's files, by name; raises for more than MOST_FILES or a file of more than `most` bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    sizes = files.select("name", "length").limit(MOST_FILES + 1).collect()
    large = sorted(r["name"] for r in sizes if r["length"] > most)
    if len(sizes) > MOST_FILES or large:
        raise ValueError(f"more than {MOST_FILES} files, or too large: {large}")
    return sorted((r["name"], r["text"]) for r in files.select("name", F.col("content").cast("string").alias("text")).collect())


def _object(name: str, text: str, keys: set[str] = frozenset()) -> dict:
    try:
        out = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{name} isn't JSON") from e
    if not isinstance(out, dict) or not keys <= set(out):
        raise ValueError(f"{name} isn't an object with {sorted(keys)}")
    return out


def sigma_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules of the YAML files of a folder, by file name; files that aren't YAML or hold no object are left out.

    A rule without a name is called as its file, one without a level is of low level; file holds the file's name.
    """
    import yaml

    out = []
    for name, text in [x for end in ("*.yml", "*.yaml") for x in texts(spark, path, end)]:
        try:
            own = yaml.safe_load(text)
        except yaml.YAMLError:
            continue
        if isinstance(own, dict):
            stem = name.rsplit(".", 1)[0]
            out.append({"name": stem, "title": stem, "level": "low", "tags": [], **own, "file": name})
    return out


def behavior_index(spark: SparkSession, path: str) -> DataFrame:
    """name, title, level, file, technique_id, validation: a row per behaviour and technique of index files."""
    one = "struct<name: string, title: string, level: string, file: string, techniques: array<string>, validation: string>"
    rows = spark.read.schema(f"behaviors array<{one}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    each = rows.select(F.explode("behaviors").alias("b")).select("b.*")
    return each.select("name", "title", "level", "file", F.explode("techniques").alias("technique_id"), "validation")


def mapping_rules(spark: SparkSession, path: str) -> tuple[list[dict], dict]:
    """Rules of all files in the order of their names, and the fallback, which just one file has to name."""
    rules, fallbacks = [], []
    for name, text in texts(spark, path, "*.json"):
        own = _object(name, text)
        rules += own.get("rules", [])
        fallbacks += [own["fallback"]] if "fallback" in own else []
    if len(fallbacks) != 1:
        raise ValueError(f"{len(fallbacks)} fallbacks")
    keep = ("technique_id", "tactic", "confidence")
    try:
        out = [{"id": r["id"], "when": r["when"], "techniques": [{k: t[k] for k in keep} for t in r.get("techniques", [])], "legacy": r.get("legacy") and {k: r["legacy"][k] for k in keep}} for r in rules]
        fallback = {k: fallbacks[0][k] for k in keep}
    except (KeyError, TypeError) as e:
        raise ValueError("a rule is incomplete") from e
    mapping.check_rules(out)
    return out, fallback


def intel_store(spark: SparkSession, path: str) -> dict[str, DataFrame | list[str]]:
    """sources, indicators, behaviors (tables as intel's own) and never_flag (ranges) of a store's folder."""
    top = dict(texts(spark, path, "*.json"))
    seed = dict(texts(spark, f"{path}/seed", "*.json"))
    if not {"sources.json", "never_flag.json"} <= set(top) or "indicators.json" not in seed:
        raise ValueError("the store lacks a file")
    ranges = _object("never_flag.json", top["never_flag.json"], {"cidrs"})["cidrs"]
    try:
        sources = [(s["source_id"], s["upstream"], s["retrieved"]) for s in _object("sources.json", top["sources.json"], {"sources"})["sources"]]
        atomic = [tuple(r[k] for k in ("type", "value", "risk", "confidence", "source_id", "retrieved", "expires", "reference")) for r in _object("indicators.json", seed["indicators.json"], {"indicators"})["indicators"]]
        behaviors = [(b["id"], b["attack_techniques"], b["event_types"], b["confidence"], b["last_reviewed"], int(b["review_interval_days"]), b["source_id"]) for n, t in texts(spark, f"{path}/behaviors", "*.json") for b in _object(n, t, {"behaviors"})["behaviors"]]
    except (KeyError, TypeError) as e:
        raise ValueError("a record is incomplete") from e
    known = spark.createDataFrame(sources, "source_id string, upstream string, retrieved string").withColumn("retrieved", F.to_date("retrieved"))
    rows = spark.createDataFrame(atomic, "type string, value string, risk string, confidence string, source_id string, retrieved string, expires string, reference string")
    rows = rows.withColumns({"retrieved": F.to_date("retrieved"), "expires": F.to_date("expires"), "value": F.lower("value")})
    records = spark.createDataFrame(behaviors, "behavior_id string, techniques array<string>, event_types array<string>, confidence string, last_reviewed string, review_days int, source_id string").withColumn("last_reviewed", F.to_date("last_reviewed"))
    return {
        "sources": known,
        "indicators": intel.checked(rows, ["type", "value", "source_id"], intel.MOST_ATOMIC, known),
        "behaviors": intel.checked(records, ["behavior_id"], intel.MOST_BEHAVIORS, known),
        "never_flag": ranges,
    }


def policy_bundle(spark: SparkSession, path: str) -> dict:
    """policy (class to decision), allow and deny (action labels) for operators.policy.decision."""
    own = _object(path, "".join(t for _, t in texts(spark, path)))
    classes = own.get("policy", {})
    if not isinstance(classes, dict) or not set(classes) <= {*CLASS_WORDS, "unknown"} or not set(classes.values()) <= set(DECISIONS):
        raise ValueError("a class or a decision isn't known")
    lists = {k: own.get(k, []) for k in ("allow", "deny")}
    if any(not isinstance(v, list) or any(not isinstance(x, str) for x in v) for v in lists.values()):
        raise ValueError("allow and deny are lists of texts")
    return {"policy": classes, **lists}


def attestations(spark: SparkSession, path: str) -> DataFrame:
    """control_id, date, expires, attested_by, statement; raises for another version, other fields, a control twice or
    an end before its start."""
    own = _object(path, "".join(t for _, t in texts(spark, path)), {"version", "attestations"})
    rows = own["attestations"]
    if own["version"] != 1 or not isinstance(rows, list):
        raise ValueError("not a list of version 1")
    for r in rows:
        if not isinstance(r, dict) or set(r) != ATTESTATION or any(not isinstance(v, str) or not v.strip() for v in r.values()):
            raise ValueError(f"an attestation has the fields {sorted(ATTESTATION)}, none empty")
        if not (DATE.fullmatch(r["date"]) and DATE.fullmatch(r["expires"]) and r["date"] <= r["expires"]):
            raise ValueError(f"dates of {r['control_id']}")
    if len({r["control_id"] for r in rows}) < len(rows):
        raise ValueError("a control twice")
    table = spark.createDataFrame([tuple(r[k] for k in ("control_id", "date", "expires", "attested_by", "statement")) for r in rows], "control_id string, date string, expires string, attested_by string, statement string")
    return table.withColumns({"date": F.to_date("date"), "expires": F.to_date("expires")})


def pin(spark: SparkSession, path: str) -> dict:
    """A pin manifest: attack_version, retrieved, bundle (file_name, size_bytes, sha256), shards (name to SHA-256)."""
    own = _object(path, "".join(t for _, t in texts(spark, path)), {"attack_version", "retrieved", "bundle", "shards"})
    bundle, shards = own["bundle"], own["shards"]
    if not isinstance(bundle, dict) or set(bundle) != {"file_name", "size_bytes", "sha256"} or not isinstance(shards, dict) or not shards:
        raise ValueError("the pin lacks its bundle or shards")
    if any(not HEX.fullmatch(str(d)) for d in [bundle["sha256"], *shards.values()]) or not isinstance(bundle["size_bytes"], int) or bundle["size_bytes"] <= 0:
        raise ValueError("a digest or size isn't one")
    if not DATE.fullmatch(str(own["retrieved"])) or any("/" in n or ".." in n for n in [bundle["file_name"], *shards]):
        raise ValueError("a date or name isn't one")
    return own


def toml_lock(spark: SparkSession, path: str) -> DataFrame:
    """name (normalised), version of the packages of a TOML lock file; packages without a version are left out."""
    rows = [(p["name"], p["version"]) for _, t in texts(spark, path, most=32 << 20) for p in tomllib.loads(t).get("package", []) if "version" in p]
    table = spark.createDataFrame(rows, "name string, version string")
    return table.withColumn("name", F.lower(F.regexp_replace("name", "[-_.]+", "-")))


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts; raises if a key is in them twice."""
    out = reduce(DataFrame.unionByName, parts)
    twice = [r[0] for r in out.groupBy(key).count().filter("count > 1").select(key).limit(5).collect()]
    if twice:
        raise ValueError(f"keys twice: {twice}")
    return out
