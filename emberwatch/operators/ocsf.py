"""OCSF classes of events, and labels of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import in_any

VERSION = "1.5.0"
#: Name and category of each class uid. Fixed values.
CLASSES = {
    0: ("Base Event", 0, "Uncategorized"),
    1001: ("File System Activity", 1, "System Activity"),
    1005: ("Module Activity", 1, "System Activity"),
    1006: ("Scheduled Job Activity", 1, "System Activity"),
    1007: ("Process Activity", 1, "System Activity"),
    1008: ("Event Log Activity", 1, "System Activity"),
    2004: ("Detection Finding", 2, "Findings"),
    3001: ("Account Change", 3, "Identity & Access Management"),
    3002: ("Authentication", 3, "Identity & Access Management"),
    4001: ("Network Activity", 4, "Network Activity"),
    4002: ("HTTP Activity", 4, "Network Activity"),
    4003: ("DNS Activity", 4, "Network Activity"),
    4009: ("Email Activity", 4, "Network Activity"),
    6003: ("API Activity", 6, "Application Activity"),
}
#: Class uid by triage event type. Fixed values.
BY_TYPE = {"authentication failure": 3002, "successful login": 3002, "account creation": 3001, "privileged group addition": 3001, "firewall block": 4001, "port scan": 4001, "arp spoofing": 4001, "network anomaly": 4001, "ids alert": 2004, "log tampering": 1008, "unknown security event": 0}
#: Activities of each source type by class uid. Fixed values.
BY_SOURCE = {
    "endpoint": {
        1007: ["process creation", "process terminated", "process access", "process tampering", "create remote thread", "execve", "syscall", "proctitle"],
        1005: ["image loaded", "driver loaded"],
        1001: ["file created", "file deleted", "file delete detected", "file stream created", "file creation time changed", "path"],
        4001: ["network connection"],
        4003: ["dns query"],
        3002: ["user_auth", "user_login", "user_acct", "cred_acq"],
        3001: ["add_user", "add_group"],
        1008: ["daemon_end", "daemon_abort"],
        1006: ["service_start", "service_stop"],
    },
    "network": {4001: ["conn", "flow", "ssl", "tls"], 4003: ["dns"], 4002: ["http"], 2004: ["alert", "notice", "anomaly"]},
    "identity": {3002: ["sign-in"]},
    "email": {4009: ["email delivery"]},
}
#: Class uid by start of an identity activity, and by source type where nothing else fits. Fixed values.
BY_PREFIX = {"user.authentication": 3002, "user.session": 3002, "user.lifecycle": 3001, "user.account": 3001, "group.user_membership": 3001, "security.threat": 2004}
BY_DOMAIN = {"cloud": 6003, "email": 4009}
BENIGN, DARKNET, MALICIOUS = ["192.0.2.0/29"], ["203.0.113.224/27"], []


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _described(uid: Column, known: Column) -> Column:
    names = {k: v[0] for k, v in CLASSES.items()}
    categories = {k: v[1] for k, v in CLASSES.items()}
    labels = {k: v[2] for k, v in CLASSES.items()}
    return F.struct(uid.alias("class_uid"), _lookup(names, uid).alias("class_name"), _lookup(categories, uid).alias("category_uid"), _lookup(labels, uid).alias("category_name"), F.lit(VERSION).alias("version"), known.alias("mapped"))


def of_type(event_type: Column) -> Column:
    """OCSF descriptor of a triage event type; mapped tells a listed type from the fallback."""
    uid = _lookup(BY_TYPE, event_type)
    return _described(F.coalesce(uid, F.lit(0)), uid.isNotNull())


def of_activity(source_type: Column, activity: Column) -> Column:
    """OCSF descriptor by source type and activity: listed pair, start of an identity activity, default of the
    source type, else base event; only the first two count as mapped."""
    own = F.lower(F.trim(F.coalesce(activity, F.lit(""))))
    pairs = {f"{s}\t{a}": uid for s, classes in BY_SOURCE.items() for uid, names in classes.items() for a in names}
    exact = _lookup(pairs, F.concat(source_type, F.lit("\t"), own))
    prefix = reduce(lambda c, kv: c.when(F.startswith(own, F.lit(kv[0])), kv[1]), BY_PREFIX.items(), F.when(F.lit(False), 0))
    prefix = F.when(source_type == "identity", prefix)
    known = F.coalesce(exact, prefix)
    return _described(F.coalesce(known, _lookup(BY_DOMAIN, source_type), F.lit(0)), known.isNotNull())


def is_canary(fields: Column) -> Column:
    """A decoy's event: it has logtype and a source or target host."""
    keys = F.map_keys(fields)
    return F.array_contains(keys, "logtype") & (F.array_contains(keys, "src_host") | F.array_contains(keys, "dst_host"))


def to_darknet(destination: Column, darknet: list[str] = DARKNET) -> Column:
    """Whether an address lies in a range that nobody uses."""
    return in_any(destination, darknet)


def source_label(source: Column, from_canary: Column, darknet_target: Column, *, benign: list[str] = BENIGN, malicious: list[str] = MALICIOUS) -> Column:
    """Label and rule of a source: malicious for canary contact or a listed range, suspicious for traffic to the
    darknet, benign-scanner for a known scanner, else unknown."""
    rules = [(from_canary, "malicious", "canary"), (in_any(source, malicious), "malicious", "malicious range"), (darknet_target, "suspicious", "darknet"), (in_any(source, benign), "benign-scanner", "benign range")]
    case = F.when(F.lit(False), F.struct(F.lit("").alias("label"), F.lit("").alias("rule")))
    for test, label, rule in rules:
        case = case.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule")))
    return case.otherwise(F.struct(F.lit("unknown").alias("label"), F.lit("none").alias("rule")))


def labelled_sources(triaged: DataFrame) -> DataFrame:
    """source, from_canary, label, rule of every source of triaged events; canary sources are those of canary events."""
    per = triaged.filter("source is not null").groupBy("source").agg(F.bool_or(is_canary(F.col("fields"))).alias("from_canary"))
    out = per.withColumn("said", source_label(F.col("source"), F.col("from_canary"), F.lit(False)))
    return out.select("source", "from_canary", "said.label", "said.rule")
