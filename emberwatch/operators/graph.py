"""Object graphs flattened to tables: nodes, edges, parents, successors, related sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_key

TECHNIQUE_ID = r"^T[0-9]{4}(\.[0-9]{3})?$"
MOST_HOPS = 10
NODE = (
    "type string, id string, name string, revoked boolean, x_mitre_deprecated boolean, x_mitre_shortname string, external_references array<struct<source_name:string,external_id:string,url:string>>, "
    "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, x_mitre_platforms array<string>, relationship_type string, source_ref string, target_ref string, x_mitre_analytic_refs array<string>, "
    "x_mitre_log_source_references array<struct<name:string,channel:string,x_mitre_data_component_ref:string>>"
)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of bundle files, a row each."""
    whole = spark.read.schema(f"objects array<struct<{', '.join(c.replace(' ', ':', 1) for c in NODE.split(', '))}>>").option("multiLine", True).json(path)
    return whole.select(F.explode("objects").alias("o")).select("o.*")


def nodes(objects: DataFrame) -> DataFrame:
    """id, type, name, external_id, status, tactics, platforms of all but relationships."""
    ref = F.get(F.filter("external_references", lambda r: F.startswith(r["source_name"], F.lit("mitre"))), F.lit(0))
    status = F.when(F.coalesce("revoked", F.lit(False)), "revoked").when(F.coalesce("x_mitre_deprecated", F.lit(False)), "deprecated").otherwise("active")
    tactics = F.array_sort(F.transform("kill_chain_phases", lambda p: p["phase_name"]))
    return objects.filter("type <> 'relationship'").select("id", "type", "name", ref["external_id"].alias("external_id"), status.alias("status"), tactics.alias("tactics"), F.array_sort("x_mitre_platforms").alias("platforms"))


def edges(objects: DataFrame) -> DataFrame:
    return objects.filter("type = 'relationship'").select(F.col("relationship_type").alias("kind"), F.col("source_ref").alias("source"), F.col("target_ref").alias("target"))


def require(objects: DataFrame, kinds: list[str], relations: list[str]) -> None:
    """Raises unless every type and relationship occurs."""
    have = {r[0] for r in objects.select("type").distinct().collect()} | {r[0] for r in objects.filter("relationship_type is not null").select("relationship_type").distinct().collect()}
    if gone := [k for k in [*kinds, *relations] if k not in have]:
        raise ValueError(f"the bundle has no {gone}")


def linked(own_edges: DataFrame, own_nodes: DataFrame, kind: str) -> DataFrame:
    """source_id, target_id (external) and types and names of both ends of one kind of edge."""
    e = own_edges.filter(F.col("kind") == kind)
    s = own_nodes.select(F.col("id").alias("source"), F.col("external_id").alias("source_id"), F.col("type").alias("source_type"), F.col("name").alias("source_name"))
    t = own_nodes.select(F.col("id").alias("target"), F.col("external_id").alias("target_id"), F.col("type").alias("target_type"), F.col("name").alias("target_name"))
    return e.join(s, "source").join(t, "target").drop("source", "target", "kind")


def parents(own_edges: DataFrame, own_nodes: DataFrame) -> DataFrame:
    return linked(own_edges, own_nodes, "subtechnique-of").select(F.col("source_id").alias("technique_id"), F.col("target_id").alias("parent_id")).distinct()


def related_sets(own_edges: DataFrame, own_nodes: DataFrame) -> DataFrame:
    """technique_id with sorted distinct names of its mitigations, groups and software."""
    m = linked(own_edges, own_nodes, "mitigates").select("target_id", "target_type", F.lit("mitigations").alias("set"), F.col("source_name").alias("name"))
    kind = F.when(F.col("source_type") == "intrusion-set", "groups").when(F.col("source_type").isin("malware", "tool"), "software")
    u = linked(own_edges, own_nodes, "uses").select("target_id", "target_type", kind.alias("set"), F.col("source_name").alias("name"))
    each = m.unionByName(u).filter("target_type = 'attack-pattern' and set is not null").distinct()
    sets = [F.array_sort(F.collect_list(F.when(F.col("set") == s, F.col("name")))).alias(s) for s in ("mitigations", "groups", "software")]
    return each.groupBy(F.col("target_id").alias("technique_id")).agg(*sets)


def detections(objects: DataFrame, own_nodes: DataFrame, own_edges: DataFrame) -> DataFrame:
    """technique_id with its detection strategies, and sorted log sources and data components behind their analytics."""
    strategies = objects.filter("x_mitre_analytic_refs is not null").select(F.col("id").alias("source"), F.col("name").alias("strategy"), F.explode_outer("x_mitre_analytic_refs").alias("analytic"))
    logs = objects.filter("type = 'x-mitre-analytic'").select(F.col("id").alias("analytic"), F.explode_outer("x_mitre_log_source_references").alias("l"))
    logs = logs.select("analytic", F.when(F.length("l.name") > 0, F.concat_ws(":", "l.name", F.nullif("l.channel", F.lit("")))).alias("log_source"), F.col("l.x_mitre_data_component_ref").alias("component"))
    components = own_nodes.filter("type = 'x-mitre-data-component'").select(F.col("id").alias("component"), F.col("name").alias("component_name"))
    each = own_edges.filter("kind = 'detects'").join(strategies, "source").join(logs, "analytic", "left").join(components, "component", "left")
    each = each.join(own_nodes.filter("type = 'attack-pattern'").select(F.col("id").alias("target"), F.col("external_id").alias("technique_id")), "target")
    return each.groupBy("technique_id").agg(*[F.array_sort(F.collect_set(c)).alias(n) for c, n in (("strategy", "strategies"), ("log_source", "log_sources"), ("component_name", "data_components"))])


def successors(objects_nodes: DataFrame, own_edges: DataFrame) -> DataFrame:
    """technique_id, successor of revoked techniques."""
    own = linked(own_edges, objects_nodes, "revoked-by").filter("source_type = 'attack-pattern'")
    return own.select(F.col("source_id").alias("technique_id"), F.col("target_id").alias("successor")).distinct()


def resolved(links: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """technique_id, current, n_hops, looped: every link followed to its end, by doubling.

    After k rounds a row points 2**k links ahead, so `hops` links take few joins; what is still on its way
    after them, or meets itself, is looped.
    """
    now = links.select("technique_id", F.col("successor").alias("current"), F.lit(1).alias("n_hops"))
    reach = 1
    while reach < hops + 1:
        ahead = now.select(F.col("technique_id").alias("__k"), F.col("current").alias("__c"), F.col("n_hops").alias("__n"))
        joined = now.join(ahead, F.col("current") == F.col("__k"), "left")
        now = joined.select("technique_id", F.coalesce("__c", "current").alias("current"), (F.col("n_hops") + F.coalesce("__n", F.lit(0))).alias("n_hops"))
        reach *= 2
    more = links.select(F.col("technique_id").alias("__k")).distinct()
    out = now.join(more, F.col("current") == F.col("__k"), "left")
    return out.select("technique_id", "current", "n_hops", (F.col("__k").isNotNull() | (F.col("n_hops") > hops)).alias("looped"))


def references(asked: DataFrame, techniques: DataFrame, tombstones: DataFrame) -> DataFrame:
    """technique_id, status (active, revoked, deprecated, unknown, malformed), successor of ids asked for."""
    t = techniques.select("technique_id", F.col("status").alias("__s"))
    g = tombstones.select("technique_id", F.col("status").alias("__g"), "successor")
    out = asked.select("technique_id").distinct().join(t, "technique_id", "left").join(g, "technique_id", "left")
    status = F.when(~F.rlike("technique_id", F.lit(TECHNIQUE_ID)), "malformed").otherwise(F.coalesce("__s", "__g", F.lit("unknown")))
    return out.select("technique_id", status.alias("status"), "successor")


def newer_versions(versions: DataFrame, pinned: str) -> DataFrame:
    """n: how many of the versions are above the pinned one, numbers compared as numbers."""
    return versions.agg(F.count_if(version_key(F.col("version")) > version_key(F.lit(pinned))).alias("n"))


def merged_ledger(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key of either; new values replace old ones, none is dropped."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def unresolved(table: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key isn't among the known ones."""
    return table.join(known.select(F.col(known_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def repeated(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).count().filter("count > 1")
