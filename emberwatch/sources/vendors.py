"""Vendor records to one event schema: schema on read over VARIANT, all vendors in one projection.

A vendor is a declaration: a test that claims a record, and per field of the event the paths to look at.
A record is parsed only if exactly one vendor claims it; everything else is carried as labelled text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.observables import observables, sysmon_hashes
from ..functions.text import bound, coerced
from ..functions.timeparse import epoch

MOST_RAW, MOST_EXCERPT, MOST_DEPTH, MOST_OBSERVABLES, MOST_RECIPIENTS = 262_144, 4096, 32, 64, 32
TEXT_ARRAY = "array<string>"


def _scalar(value: Column) -> Column:
    """A scalar VARIANT as bounded text. A cast renders objects and arrays as JSON, so what looks like one is looked at again."""

    def text(s: Column) -> Column:
        kind = F.schema_of_variant(value)
        container = F.substring(s, 1, 1).isin("{", "[") & (F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")))
        return F.when(~container, coerced(s))

    return bound(F.try_variant_get(value, "$", "string"), text)


class Payload:
    """Values of a VARIANT column by path, coerced to bounded text; containers and missing paths are null.

    Given cells, texts are elements of that column of arrays, each path once; `owner` is whose declaration is being
    read, and `asked` has the paths of each owner in the order of their elements (see texts_of).
    """

    def __init__(self, column: str, cells: str | None = None) -> None:
        self.v, self.keys = F.col(column), F.col(f"{column}_keys")
        self.cells, self.owner = F.col(cells) if cells else None, ""
        self.asked: dict[str, dict[str, Column]] = {}

    def raw(self, path: str) -> Column:
        return F.try_variant_get(self.v, path if path.startswith("$") else f"$.{path}", "variant")

    def text(self, path: str) -> Column:
        if self.cells is None:
            return _scalar(self.raw(path))
        own = self.asked.setdefault(self.owner, {})
        if path not in own:
            own[path] = F.get(self.cells, F.lit(len(own)))
        return own[path]

    def texts_of(self, owner: Column | None = None) -> Column:
        """The texts asked for as an array: of all paths, or of those of the row's owner only."""
        values = F.lit(None).cast("array<variant>")
        for name, own in self.asked.items():
            paths = F.array(*map(self.raw, own))
            values = paths if owner is None else F.when(owner == name, paths).otherwise(values)
        return F.transform(values, _scalar)

    def first(self, *paths: str) -> Column:
        return F.coalesce(*map(self.text, paths)) if paths else F.lit(None).cast("string")

    def has(self, *keys: str) -> Column:
        return F.coalesce(F.arrays_overlap(self.keys, F.array(*map(F.lit, keys))), F.lit(False))

    def given(self, *paths: str) -> Column:
        """Whether one of the paths holds something other than null."""
        tests = [F.coalesce(~F.is_variant_null(self.raw(p)), F.lit(False)) for p in paths]
        return reduce(lambda a, b: a | b, tests)

    def is_object(self, path: str) -> Column:
        return F.coalesce(F.startswith(F.schema_of_variant(self.raw(path)), F.lit("OBJECT")), F.lit(False))

    def texts(self, *paths: str, most: int) -> Column:
        """A text or an array of texts at the first path that has either, as distinct texts in order, at most `most`."""
        own = []
        for p in paths:
            one = self.text(p)
            many = F.transform(F.try_variant_get(self.v, f"$.{p}", TEXT_ARRAY), lambda x: coerced(x))
            own.append(F.when(F.size(F.array_compact(many)) > 0, F.array_compact(many)).when(one.isNotNull(), F.array(one)))
        return F.slice(F.array_distinct(F.coalesce(*own, F.array().cast(TEXT_ARRAY))), 1, most)


def _labelled(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value)


@dataclass(frozen=True)
class Vendor:
    name: str
    domain: str
    claims: Callable[[Payload], Column]
    event_id: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    activity: Callable[[Payload], Column] | None = None
    message: Callable[[Payload], list[Column]] = lambda p: []
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)  # "struct.field" -> paths
    built: dict[str, Callable[[Payload], Column]] = field(default_factory=dict)  # the same, computed
    watched: Callable[[Payload], list[Column]] = lambda p: []
    notes: Callable[[Payload], list[Column]] = lambda p: []  # null where there is nothing to note


#: Sysmon event ids. Fixed values.
SYSMON = {
    "1": "process creation",
    "2": "file creation time changed",
    "3": "network connection",
    "5": "process terminated",
    "6": "driver loaded",
    "7": "image loaded",
    "8": "create remote thread",
    "10": "process access",
    "11": "file created",
    "12": "registry key created or deleted",
    "13": "registry value set",
    "14": "registry key renamed",
    "15": "file stream created",
    "17": "pipe created",
    "18": "pipe connected",
    "22": "dns query",
    "23": "file deleted",
    "25": "process tampering",
    "26": "file delete detected",
}
#: Record types of auditd, Zeek streams and Suricata event types that are claimed. Fixed values.
AUDITD = ["SYSCALL", "EXECVE", "PROCTITLE", "PATH", "USER_AUTH", "USER_ACCT", "USER_CMD", "USER_LOGIN", "USER_START", "CRED_ACQ", "CRED_REFR", "ADD_USER", "ADD_GROUP", "CONFIG_CHANGE", "DAEMON_END", "DAEMON_ABORT", "SERVICE_START", "SERVICE_STOP", "SYSTEM_SHUTDOWN", "ANOM_ABEND"]
ZEEK = ["conn", "dns", "http", "ssl", "files", "notice", "weird"]
SURICATA = ["alert", "dns", "http", "tls", "flow", "fileinfo", "anomaly", "ssh", "smb"]

SYSMON_ID = ("EventID", "event_id", "System.EventID")


def _in_data(*names: str) -> tuple[str, ...]:
    """Sysmon keeps its data below EventData or at the top."""
    return tuple(x for n in names for x in (f"EventData.{n}", n))


def _sysmon_activity(p: Payload) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SYSMON.items() for x in kv])
    return F.coalesce(F.element_at(table, p.first(*SYSMON_ID)), F.concat(F.lit("sysmon event "), p.first(*SYSMON_ID)))


def _argv(p: Payload) -> Column:
    """a0, a1, ... of a record, by number, joined by blanks."""
    entries = F.map_entries(F.from_json(F.to_json(p.v), "map<string,string>"))
    own = F.filter(entries, lambda e: F.rlike(e["key"], F.lit("^a[0-9]+$")))
    pairs = F.transform(own, lambda e: F.struct(F.substring(e["key"], 2, 9).try_cast("int").alias("n"), coerced(e["value"]).alias("v")))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), " "), F.lit(""))


def _audit_command(p: Payload) -> Column:
    return F.coalesce(p.text("proctitle"), _argv(p), p.text("cmd"))


def _flow(p: Payload, src: tuple, sport: tuple, dst: tuple, dport: tuple) -> Column:
    def end(ip: tuple, port: tuple) -> Column:
        return F.concat(p.first(*ip), F.lit(":"), F.coalesce(p.first(*port), F.lit("None")))

    return F.concat(end(src, sport), F.lit(" -> "), end(dst, dport))


def _zeek(name: str) -> tuple[str, str]:
    return (f"$['id.{name}']", f"id.{name}")


def _azure_operation(p: Payload) -> Column:
    return F.coalesce(p.text("operationName"), p.text("operationName.value"), p.text("operationName.localizedValue"))


def _entra_mfa(p: Payload) -> Column:
    methods = F.try_variant_get(p.v, "$.authenticationDetails", "array<struct<authenticationMethod:string>>")
    own = F.slice(F.array_distinct(F.array_compact(F.transform(methods, lambda m: coerced(m["authenticationMethod"])))), 1, 8)
    return F.coalesce(p.text("authenticationRequirement"), F.when(F.size(own) > 0, F.array_join(own, ", ")))


def _entra_outcome(p: Payload) -> Column:
    code, reason = p.text("status.errorCode"), p.text("status.failureReason")
    stated = F.when(F.coalesce(code, F.lit("0")) == "0", "success").otherwise(F.concat(F.lit("failure ("), code, F.lit(")")))
    return F.when(code.isNotNull() | reason.isNotNull(), stated)


def _count(name: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}="), F.size(values).cast("string")))


def _mail(sender: tuple, recipients: tuple, ids: tuple, delivery: tuple, urls: str) -> tuple[dict, dict]:
    fields = {"email.sender": sender, "email.subject": ("Subject", "subject"), "email.message_id": ids, "email.delivery_action": delivery, "actor.user_principal": sender}
    return fields, {"email.recipients": lambda p: p.texts(*recipients, most=MOST_RECIPIENTS), "email.urls": lambda p: p.texts(urls, most=MOST_OBSERVABLES)}


DEFENDER = _mail(("SenderFromAddress", "SenderMailFromAddress"), ("RecipientEmailAddress",), ("InternetMessageId", "NetworkMessageId"), ("DeliveryAction",), "UrlList")
WORKSPACE = _mail(("sender_address", "from_address"), ("recipient_addresses", "recipient_address"), ("rfc2822_message_id", "message_id"), ("status", "delivery_status", "action"), "urls")

VENDORS = [
    Vendor(
        "sysmon",
        "endpoint",
        lambda p: F.coalesce(F.contains(F.lower(p.first("Provider", "provider_name", "Channel", "channel", "System.Provider.Name", "System.Channel")), F.lit("sysmon")), F.lit(False)) & p.first(*SYSMON_ID).isNotNull(),
        SYSMON_ID,
        (*_in_data("UtcTime"), "$['@timestamp']", "System.TimeCreated.SystemTime"),
        _sysmon_activity,
        lambda p: [_sysmon_activity(p), _labelled("image", p.first(*_in_data("Image", "SourceImage"))), _labelled("parent", p.first(*_in_data("ParentImage", "SourceImage"))), _labelled("cmd", p.first(*_in_data("CommandLine"))), _labelled("query", p.first(*_in_data("QueryName", "DestinationHostname")))],
        {
            "actor.user_name": _in_data("User", "SubjectUserName"),
            "actor.process_name": _in_data("Image", "SourceImage"),
            "actor.process_pid": _in_data("ProcessId", "SourceProcessId"),
            "actor.parent_process_name": _in_data("ParentImage", "SourceImage"),
            "actor.command_line": _in_data("CommandLine"),
            "device.hostname": ("EventData.Computer", "Computer", "System.Computer", "hostname"),
            "src_endpoint.ip": _in_data("SourceIp"),
            "src_endpoint.port": _in_data("SourcePort"),
            "dst_endpoint.ip": _in_data("DestinationIp", "DestinationIpv6"),
            "dst_endpoint.port": _in_data("DestinationPort"),
            "dst_endpoint.domain": _in_data("QueryName", "DestinationHostname"),
        },
        {"device.os": lambda p: F.lit("windows")},
        lambda p: [p.first(*_in_data("Image", "SourceImage")), p.first(*_in_data("CommandLine")), p.first(*_in_data("DestinationIp", "DestinationIpv6")), p.first(*_in_data("QueryName", "DestinationHostname")), F.array_join(sysmon_hashes(p.first(*_in_data("Hashes"))), " ")],
        lambda p: [F.when(~p.first(*SYSMON_ID).isin(list(SYSMON)), "event id isn't known")],
    ),
    Vendor(
        "auditd",
        "endpoint",
        lambda p: F.upper(p.text("type")).isin(AUDITD) & p.given("exe", "comm", "syscall", "auid", "ses", "acct", "key", "proctitle", "msg"),
        (),
        ("$['@timestamp']", "timestamp"),
        lambda p: F.lower(p.text("type")),
        lambda p: [F.concat(F.lit("auditd "), F.upper(p.text("type"))), _labelled("exe", p.first("exe", "comm")), _labelled("cmd", _audit_command(p)), _labelled("key", p.text("key")), _labelled("res", p.first("res", "success"))],
        {"actor.user_name": ("acct", "auid", "uid"), "actor.user_uid": ("uid",), "actor.process_name": ("exe", "comm"), "actor.process_pid": ("pid",), "actor.parent_process_name": ("ppid_exe",), "device.hostname": ("node", "hostname"), "src_endpoint.ip": ("addr",)},
        {"device.os": lambda p: F.lit("linux"), "actor.command_line": _audit_command, "vendor_event_id": lambda p: F.upper(p.text("type")), "timestamp": lambda p: F.coalesce(epoch(p.first("$['@timestamp']", "timestamp")), epoch(F.nullif(F.regexp_extract(p.text("msg"), r"audit\((\d+\.\d+):(\d+)\)", 1), F.lit(""))))},
        lambda p: [p.first("exe", "comm"), _audit_command(p), p.text("addr")],
    ),
    Vendor(
        "zeek",
        "network",
        lambda p: (p.has("id.orig_h") & p.has("id.resp_h")) | (F.coalesce(p.first("_path", "_write_ts_path").isin(ZEEK), F.lit(False)) & p.has("uid")),
        ("uid",),
        ("ts", "$['@timestamp']"),
        lambda p: F.coalesce(p.first("_path", "_write_ts_path"), F.lit("conn")),
        lambda p: [
            F.concat(F.lit("zeek "), F.coalesce(p.first("_path", "_write_ts_path"), F.lit("conn"))),
            _flow(p, _zeek("orig_h"), _zeek("orig_p"), _zeek("resp_h"), _zeek("resp_p")),
            _labelled("proto", p.first("proto", "service")),
            _labelled("query", p.first("query", "server_name", "host")),
            _labelled("uri", p.text("uri")),
        ],
        {"device.hostname": ("_node",), "src_endpoint.ip": _zeek("orig_h"), "src_endpoint.port": _zeek("orig_p"), "dst_endpoint.ip": _zeek("resp_h"), "dst_endpoint.port": _zeek("resp_p"), "dst_endpoint.domain": ("query", "server_name", "host")},
        {},
        lambda p: [p.first(*_zeek("orig_h")), p.first(*_zeek("resp_h")), p.first("query", "server_name", "host"), p.text("uri")],
        lambda p: [F.when(~F.coalesce(p.first("_path", "_write_ts_path"), F.lit("conn")).isin(ZEEK), "stream isn't known")],
    ),
    Vendor(
        "suricata",
        "network",
        lambda p: F.lower(p.text("event_type")).isin(SURICATA) & p.has("src_ip") & p.has("dest_ip"),
        ("alert.signature_id", "flow_id"),
        ("timestamp", "$['@timestamp']"),
        lambda p: F.lower(p.text("event_type")),
        lambda p: [
            F.concat(F.lit("suricata "), F.lower(p.text("event_type"))),
            _flow(p, ("src_ip",), ("src_port",), ("dest_ip",), ("dest_port",)),
            _labelled("signature", p.text("alert.signature")),
            _labelled("severity", p.text("alert.severity")),
            _labelled("query", p.first("dns.rrname", "http.hostname")),
        ],
        {"actor.user_name": ("ssh.client.software_version",), "device.hostname": ("host",), "src_endpoint.ip": ("src_ip",), "src_endpoint.port": ("src_port",), "dst_endpoint.ip": ("dest_ip",), "dst_endpoint.port": ("dest_port",), "dst_endpoint.domain": ("dns.rrname", "http.hostname")},
        {},
        lambda p: [p.text("src_ip"), p.text("dest_ip"), p.first("dns.rrname", "http.hostname"), p.text("http.url")],
    ),
    Vendor(
        "aws-cloudtrail",
        "cloud",
        lambda p: F.endswith(p.text("eventSource"), F.lit(".amazonaws.com")) & p.given("eventName"),
        ("eventID",),
        ("eventTime",),
        lambda p: p.text("eventName"),
        lambda p: [
            F.concat(F.lit("cloudtrail "), p.text("eventName")),
            _labelled("service", p.text("eventSource")),
            _labelled("principal", p.first("userIdentity.userName", "userIdentity.sessionContext.sessionIssuer.userName", "userIdentity.principalId", "userIdentity.type")),
            _labelled("src", p.text("sourceIPAddress")),
            _labelled("mfa", p.text("userIdentity.sessionContext.attributes.mfaAuthenticated")),
            F.coalesce(_labelled("error", p.text("errorCode")), F.lit("outcome=success")),
        ],
        {
            "actor.user_name": ("userIdentity.userName", "userIdentity.sessionContext.sessionIssuer.userName", "userIdentity.principalId", "userIdentity.type"),
            "actor.identity": ("userIdentity.arn",),
            "device.hostname": ("userAgent",),
            "src_endpoint.ip": ("sourceIPAddress",),
            "cloud.account_uid": ("recipientAccountId", "userIdentity.accountId"),
            "cloud.region": ("awsRegion",),
            "cloud.service": ("eventSource",),
        },
        {"cloud.provider": lambda p: F.lit("aws")},
        lambda p: [p.text("sourceIPAddress"), p.text("userIdentity.arn")],
        lambda p: [F.when(~p.is_object("userIdentity"), "no identity")],
    ),
    Vendor(
        "azure-activity",
        "cloud",
        lambda p: _azure_operation(p).isNotNull() & p.has("resourceId", "resourceUri", "subscriptionId"),
        ("correlationId", "eventDataId"),
        ("eventTimestamp", "time", "$['@timestamp']"),
        _azure_operation,
        lambda p: [F.concat(F.lit("azure-activity "), _azure_operation(p)), _labelled("caller", p.first("caller", "claims.name")), _labelled("src", p.text("callerIpAddress")), _labelled("status", p.first("status.value", "status", "resultType")), _labelled("resource", p.first("resourceId", "resourceUri"))],
        {"actor.user_principal": ("caller", "claims.name"), "actor.identity": ("claims.appid",), "src_endpoint.ip": ("callerIpAddress",), "cloud.account_uid": ("subscriptionId", "tenantId"), "cloud.region": ("location",), "cloud.service": ("resourceProvider", "category")},
        {"cloud.provider": lambda p: F.lit("azure")},
        lambda p: [p.text("callerIpAddress"), p.first("resourceId", "resourceUri")],
    ),
    Vendor(
        "entra-id",
        "identity",
        lambda p: p.given("userPrincipalName") & p.has("appDisplayName", "conditionalAccessStatus", "authenticationRequirement", "riskLevelDuringSignIn"),
        ("id", "correlationId"),
        ("createdDateTime", "$['@timestamp']"),
        lambda p: F.lit("sign-in"),
        lambda p: [
            F.lit("entra sign-in"),
            _labelled("upn", p.text("userPrincipalName")),
            _labelled("app", p.text("appDisplayName")),
            _labelled("src", p.text("ipAddress")),
            _labelled("country", p.text("location.countryOrRegion")),
            _labelled("mfa", _entra_mfa(p)),
            _labelled("risk", p.first("riskLevelDuringSignIn", "riskState")),
            _labelled("outcome", _entra_outcome(p)),
            _labelled("reason", p.text("status.failureReason")),
        ],
        {"actor.user_name": ("userDisplayName",), "actor.user_principal": ("userPrincipalName",), "actor.user_uid": ("userId",), "actor.identity": ("appId",), "device.device_id": ("deviceDetail.deviceId",), "device.hostname": ("deviceDetail.displayName",), "device.os": ("deviceDetail.operatingSystem",), "src_endpoint.ip": ("ipAddress",)},
        {},
        lambda p: [p.text("ipAddress"), p.text("userPrincipalName")],
        lambda p: [F.when(_entra_outcome(p).isNull(), "no outcome stated")],
    ),
    Vendor(
        "okta",
        "identity",
        lambda p: F.contains(p.text("eventType"), F.lit(".")) & p.is_object("actor") & p.is_object("outcome"),
        ("uuid",),
        ("published", "$['@timestamp']"),
        lambda p: p.text("eventType"),
        lambda p: [
            F.concat(F.lit("okta "), p.text("eventType")),
            _labelled("actor", p.first("actor.alternateId", "actor.displayName")),
            _labelled("src", p.text("client.ipAddress")),
            _labelled("country", p.text("client.geographicalContext.country")),
            _labelled("outcome", p.text("outcome.result")),
            _labelled("reason", p.text("outcome.reason")),
            _labelled("behaviors", p.text("debugContext.debugData.behaviors")),
        ],
        {"actor.user_name": ("actor.displayName",), "actor.user_principal": ("actor.alternateId", "actor.displayName"), "actor.user_uid": ("actor.id",), "device.hostname": ("client.device",), "device.os": ("client.userAgent.os",), "src_endpoint.ip": ("client.ipAddress",)},
        {},
        lambda p: [p.text("client.ipAddress"), p.first("actor.alternateId", "actor.displayName")],
    ),
    Vendor(
        "defender-o365",
        "email",
        lambda p: p.given("NetworkMessageId") & p.has("SenderFromAddress", "RecipientEmailAddress", "DeliveryAction", "ThreatTypes"),
        ("NetworkMessageId",),
        ("Timestamp", "$['@timestamp']"),
        lambda p: F.lit("email delivery"),
        lambda p: [
            F.lit("defender-o365 email"),
            _labelled("sender", p.first(*DEFENDER[0]["email.sender"])),
            _count("recipients", DEFENDER[1]["email.recipients"](p)),
            _labelled("subject", p.text("Subject")),
            _labelled("delivery", p.text("DeliveryAction")),
            _labelled("threat", p.text("ThreatTypes")),
            _labelled("auth", p.text("AuthenticationDetails")),
            _labelled("action", p.text("EmailAction")),
        ],
        DEFENDER[0] | {"src_endpoint.ip": ("SenderIPv4", "SenderIPv6"), "src_endpoint.domain": ("SenderFromDomain",)},
        DEFENDER[1],
        lambda p: [p.first("SenderIPv4", "SenderIPv6"), p.first(*DEFENDER[0]["email.sender"]), F.array_join(DEFENDER[1]["email.urls"](p), " ")],
        lambda p: [F.when(p.text("DeliveryAction").isNull(), "no delivery verdict")],
    ),
    Vendor(
        "google-workspace",
        "email",
        lambda p: p.given("message_id", "rfc2822_message_id") & p.has("sender_address", "recipient_address", "recipient_addresses", "event_info"),
        ("message_id", "rfc2822_message_id"),
        ("event_timestamp", "$['@timestamp']"),
        lambda p: F.lit("email delivery"),
        lambda p: [
            F.lit("workspace email"),
            _labelled("sender", p.first(*WORKSPACE[0]["email.sender"])),
            _count("recipients", WORKSPACE[1]["email.recipients"](p)),
            _labelled("subject", p.text("subject")),
            _labelled("status", p.first(*WORKSPACE[0]["email.delivery_action"])),
            _labelled("spam", p.first("spam_classification", "is_spam")),
            _labelled("info", p.text("event_info")),
        ],
        WORKSPACE[0] | {"src_endpoint.ip": ("sender_ip", "source_ip")},
        WORKSPACE[1],
        lambda p: [p.first("sender_ip", "source_ip"), p.first(*WORKSPACE[0]["email.sender"]), F.array_join(WORKSPACE[1]["email.urls"](p), " ")],
        lambda p: [F.when(p.first(*WORKSPACE[0]["email.delivery_action"]).isNull(), "no delivery verdict")],
    ),
]

STRUCTS = {
    "actor": ["user_name", "user_uid", "user_principal", "identity", "process_name", "process_pid", "parent_process_name", "command_line"],
    "device": ["hostname", "device_id", "ip", "os"],
    "src_endpoint": ["ip", "port", "domain"],
    "dst_endpoint": ["ip", "port", "domain"],
    "cloud": ["provider", "account_uid", "region", "service"],
    "email": ["sender", "recipients", "subject", "message_id", "delivery_action", "urls"],
}


def _absent() -> tuple[dict[str, Column], dict[str, Column]]:
    """Fields and structs of an event that its vendor doesn't have."""
    texts, none = F.array().cast(TEXT_ARRAY), F.lit(None).cast("string")
    fields = {f"{s}.{f}": (texts if f in ("recipients", "urls") else none).alias(f) for s, own in STRUCTS.items() for f in own}
    return fields, {s: F.struct(*[fields[f"{s}.{f}"] for f in own]).alias(s) for s, own in STRUCTS.items()}


def _event(v: Vendor, p: Payload, fields: dict[str, Column], structs: dict[str, Column]) -> Column:
    """The event of one vendor as a struct; fields and structs: what stands for those it doesn't have."""

    def value(name: str) -> Column:
        if name not in v.built and name not in v.fields:
            return fields[name]
        return (v.built[name](p) if name in v.built else p.first(*v.fields[name])).alias(name.split(".")[1])

    held = {name.split(".")[0] for name in (*v.built, *v.fields)}
    time = v.built["timestamp"](p) if "timestamp" in v.built else epoch(p.first(*v.times))
    notes = F.array_compact(F.array(F.when(time.isNull(), "no usable timestamp"), *v.notes(p)))
    parts = [F.struct(*[value(f"{s}.{f}") for f in own]).alias(s) if s in held else structs[s] for s, own in STRUCTS.items()]
    return F.struct(
        F.lit(v.domain).alias("source_type"),
        F.lit(v.name).alias("vendor"),
        (v.built["vendor_event_id"](p) if "vendor_event_id" in v.built else p.first(*v.event_id)).alias("vendor_event_id"),
        time.alias("timestamp"),
        F.array_join(F.array_compact(F.array(*v.message(p))), " ").alias("message"),
        v.activity(p).alias("activity"),
        F.when(F.size(notes) > 0, "partial").otherwise("structured").alias("parse_status"),
        *parts,
        F.array_join(F.array_compact(F.array(*v.watched(p))), " ").alias("watched"),
        notes.alias("notes"),
    )


def nesting(text: Column) -> Column:
    """Depth of brackets outside string literals of JSON text."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def with_payload(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with payload (VARIANT of a JSON object within bounds), payload_keys and problem (why there is none)."""
    text = F.col(raw).cast("string")
    large = F.length(text) > MOST_RAW
    brackets = 2 * F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) - F.length(F.replace(text, F.lit("["), F.lit("")))
    df = df.withColumn("__deep", F.when(~large & (brackets > MOST_DEPTH), nesting(text) > MOST_DEPTH).otherwise(False))
    parsed = F.when(~F.coalesce(large, F.lit(False)) & ~F.col("__deep"), F.try_parse_json(text))
    df = df.withColumn("payload", F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed))
    problem = F.when(large, "too large").when(F.col("__deep"), "too deep").when(F.col("payload").isNull() & F.startswith(F.trim(text), F.lit("{")), "not JSON")
    keys = F.coalesce(F.when(F.col("payload").isNotNull(), F.json_object_keys(text)), F.array().cast(TEXT_ARRAY))
    return df.withColumns({"payload_keys": keys, "problem": problem}).drop("__deep")


def claim_tests(p: Payload, vendors: list[Vendor] = VENDORS) -> list[Column]:
    """Per vendor its name where it recognises the record, else null."""
    return [F.when(F.coalesce(v.claims(p), F.lit(False)), F.lit(v.name)) for v in vendors]


def claims(df: DataFrame) -> DataFrame:
    """df (with payload) with claimed_by: the vendors that recognise each record."""
    return df.withColumn("claimed_by", F.array_compact(F.array(*claim_tests(Payload("payload")))))


def normalised(df: DataFrame, raw: str = "raw", vendors: list[Vendor] = VENDORS) -> DataFrame:
    """df with event: one struct per row, parsed if exactly one vendor claims it, else carried as text.

    Rows keep their order columns; nothing shuffles. Null raw text counts as empty.
    """
    df = with_payload(df, raw)
    first = Payload("payload", "__c")
    tests = claim_tests(first, vendors)
    df = df.withColumn("__c", first.texts_of()).withColumn("claimed_by", F.array_compact(F.array(*tests)))
    df = df.withColumn("__vendor", F.when(F.size("claimed_by") == 1, F.get("claimed_by", F.lit(0))))
    # every path of a record's vendor is read once
    p, parsed = Payload("payload", "__p"), F.when(F.lit(False), F.lit(None))
    fields, structs = _absent()
    for v in vendors:
        p.owner = v.name
        parsed = parsed.when(F.col("__vendor") == v.name, _event(v, p, fields, structs))
    df = df.withColumn("__p", p.texts_of(F.col("__vendor")))
    text = F.coalesce(F.col(raw).cast("string"), F.lit(""))
    message = F.coalesce(coerced(text, MOST_EXCERPT), F.lit(""))
    note = F.coalesce("problem", F.when(F.col("payload").isNotNull(), "no vendor claims this record alone"))
    plain = F.struct(
        F.lit("unknown").alias("source_type"),
        F.lit("unrecognized").alias("vendor"),
        F.lit(None).cast("string").alias("vendor_event_id"),
        F.lit(None).cast("double").alias("timestamp"),
        message.alias("message"),
        F.lit(None).cast("string").alias("activity"),
        F.when(note.isNotNull(), "partial").otherwise("text").alias("parse_status"),
        *structs.values(),
        F.substring(message, 1, 2048).alias("watched"),
        F.array_compact(F.array(note)).alias("notes"),
    )
    df = df.withColumn("event", F.coalesce(parsed, plain))
    seen = observables(F.col("event.watched"), MOST_OBSERVABLES)
    df = df.withColumn("event", F.col("event").withField("observables", seen).dropFields("watched"))
    return df.withColumn("raw_excerpt", F.substring(text, 1, MOST_EXCERPT)).drop("payload", "payload_keys", "problem", "__vendor", "__c", "__p")


#: Columns that rules match on, and where they are in an event.
VIEW = {
    "source_type": "source_type",
    "vendor": "vendor",
    "message": "message",
    "activity": "activity",
    "event_id": "vendor_event_id",
    "user": "actor.user_name",
    "user_uid": "actor.user_uid",
    "user_principal": "actor.user_principal",
    "identity": "actor.identity",
    "image": "actor.process_name",
    "process_pid": "actor.process_pid",
    "parent_image": "actor.parent_process_name",
    "command_line": "actor.command_line",
    "host": "device.hostname",
    "os": "device.os",
    "src_ip": "src_endpoint.ip",
    "src_port": "src_endpoint.port",
    "dst_ip": "dst_endpoint.ip",
    "dst_port": "dst_endpoint.port",
    "dst_domain": "dst_endpoint.domain",
    "cloud_provider": "cloud.provider",
    "cloud_account": "cloud.account_uid",
    "cloud_region": "cloud.region",
    "sender": "email.sender",
    "subject": "email.subject",
}


def match_view(df: DataFrame, *keep: str) -> DataFrame:
    """The flat columns that rules match on; what an event doesn't have is null."""
    return df.select(*keep, *[F.nullif(F.col(f"event.{path}"), F.lit("")).alias(name) for name, path in VIEW.items()])
