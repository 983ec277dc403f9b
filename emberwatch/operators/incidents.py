"""Incidents over sources: records of any vendor that name the same user, host, address or mailbox within a time, and what they add
up to.

An entity's records are cut into sessions wherever it is silent for longer than the window. Records in one session belong together, and so do
sessions that share a record; an incident is all that hangs together in this way. An entity that is seen with more than `hub` others
(a shared address, a mailing list, a service account) says nothing about who did what: it links nothing, and its records come
together by what else they name.

Times of a slot as wide as the window are always one session. So an entity's times are first reduced to the first and last of each slot, as
many as the time range has windows however many records there are, and only slots are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .components import components


#: The fields of a normalised record that say who and what it is about.
FIELDS = {
    "user_name": "actor.user_name",
    "user_principal": "actor.user_principal",
    "hostname": "device.hostname",
    "device_ip": "device.ip",
    "src_ip": "src_endpoint.ip",
    "dst_ip": "dst_endpoint.ip",
    "sender": "email.sender",
    "recipients": "email.recipients",
}


def entities() -> Column:
    """What a record with FIELDS names, as kind:value, in lower case, each once. A mailbox or principal also names the user before its @."""

    def named(kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.nullif(F.lower(F.trim(value)), F.lit("")))

    def account(value: Column) -> Column:
        return F.array(F.when(F.contains(value, F.lit("@")), named("mail", value)), named("user", F.substring_index(value, "@", 1)))

    places = [named("host", F.col("hostname")), *[named("address", F.col(k)) for k in ("device_ip", "src_ip", "dst_ip")]]
    mailboxes = F.flatten(F.transform(F.coalesce("recipients", F.array().cast("array<string>")), account))
    accounts = [account(F.col(k)) for k in ("user_name", "user_principal", "sender")]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*places), *accounts, mailboxes))))


def hubs(records: DataFrame, most: int) -> DataFrame:
    """entity, partners of the entities named together with more than `most` others."""
    pairs = records.select(F.explode("entities").alias("entity"), "entities").select("entity", F.explode("entities").alias("partner")).filter("entity <> partner")
    return pairs.distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("partners")).filter(F.col("partners") > most)


def assigned(records: DataFrame, *, window: float, hub: int) -> DataFrame:
    """record_id, incident_id of records (record_id: number, at: seconds, entities); incident_id is the smallest record_id in it.

    A record without a time, or that names nothing but hubs, is an incident of its own.
    """
    if window <= 0:
        raise ValueError("the window has to be positive")
    own = records.select(F.col("record_id").cast("long").alias("record_id"), F.col("at").cast("double").alias("at"), F.array_distinct(F.coalesce("entities", F.array().cast("array<string>"))).alias("entities"))
    named = own.filter("at is not null").select("record_id", "at", F.explode("entities").alias("entity"), F.floor(F.col("at") / window).alias("slot"))
    named = named.join(hubs(own, hub).select("entity"), "entity", "left_anti")
    slots = named.groupBy("entity", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("record_id").alias("least"))
    order = Window.partitionBy("entity").orderBy("slot")
    silent = F.col("first") - F.lag("last").over(order)
    begun = slots.withColumn("begins", F.when(silent.isNull() | (silent > window), F.col("slot")))
    sessions = kept(begun.withColumn("session", F.max("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("entity", "slot", "session", "least"))
    # the least record of a session stands for it
    leads = sessions.groupBy("entity", "session").agg(F.min("least").alias("lead"))
    led = named.join(sessions.join(leads, ["entity", "session"]).select("entity", "slot", "lead"), ["entity", "slot"])
    # as many leads as the record names entities
    leads = kept(led.groupBy("record_id").agg(F.min("lead").alias("lead"), F.collect_set("lead").alias("leads")))
    links = leads.select(F.col("lead").alias("a"), F.explode("leads").alias("b")).filter("a <> b").distinct()
    roots = components(links).withColumnsRenamed({"node": "lead"})
    found = leads.join(roots, "lead", "left").select("record_id", F.coalesce("root", "lead").alias("incident_id"))
    return own.select("record_id").join(found, "record_id", "left").select("record_id", F.coalesce("incident_id", "record_id").alias("incident_id"))


def incidents(records: DataFrame, *, window: float, hub: int, per_source: float = 0.25, most: float = 100.0) -> DataFrame:
    """incident_id, n_records, n_entities, sources, first, last, span, score of records (also source, score).

    A source counts with its highest score, so that a loud one doesn't outweigh others, and each source beyond the first raises the sum by
    per_source: what several sources saw is likelier true. `most` caps it.
    """
    member = kept(records.join(assigned(records, window=window, hub=hub), "record_id").select("incident_id", "at", "source", "score", "entities"))
    by_source = member.groupBy("incident_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("score").alias("score"))
    total = F.sum("score") * (1 + per_source * (F.count("source") - 1))
    out = by_source.groupBy("incident_id").agg(
        F.sum("n").alias("n_records"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.bround(F.least(F.lit(most), F.coalesce(total, F.lit(0.0))), 4).alias("score"),
    )
    named = member.select("incident_id", F.explode("entities").alias("entity")).distinct().groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_entities"))
    out = out.join(named, "incident_id", "left")
    return out.select("incident_id", "n_records", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "sources", "first", "last", (F.col("last") - F.col("first")).alias("span"), "score")
