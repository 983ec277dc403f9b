"""Event triage: type, severity, source, indicators, evidence and actions of log events.

Operators take rows with `text` (flat log text) and `fields` (map of structured fields, null or
empty for plain text) and add columns; nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import is_dotted_quad, is_ip
from ..functions.text import all_of, any_of, stripped

#: Score of each severity. Fixed values.
BASE_SCORES = {"critical": 90, "high": 70, "medium": 45, "low": 20, "unknown": 0}
#: Severity of event types that have one whoever is involved. Fixed values.
PLAIN_SEVERITY = {
    "arp spoofing": "high",
    "log tampering": "high",
    "privileged group addition": "high",
    "account creation": "medium",
    "port scan": "medium",
    "ids alert": "medium",
    "firewall block": "low",
    "network anomaly": "low",
}
#: Severity with and without a privileged account. Fixed values.
ACCOUNT_SEVERITY = {"authentication failure": ("high", "medium"), "successful login": ("high", "low")}
SOURCE_FIELDS = ("src_ip", "source_ip", "ip", "remote_addr", "src_host")
INDICATOR_FIELDS = SOURCE_FIELDS[:4]
EVIDENCE = {
    "timestamp": "time of the event",
    "host": "system concerned",
    "user": "account concerned",
    "src_ip": "network origin",
    "source_ip": "network origin",
    "severity": "severity stated by the sender",
    "message": "text that was classified",
}
ACTIONS = {
    "authentication failure": ["Count attempts of the same source.", "Check lockout, second factor and exposure of the service."],
    "successful login": ["Ask whether the login was expected.", "Look at what the session did next."],
    "ids alert": ["Read the signature and the captured packets.", "Check how exposed the target is."],
    "log tampering": ["Assume the host is compromised until shown otherwise.", "Fetch forwarded copies of the logs."],
    "privileged group addition": ["Match the change with an approved request.", "Check when the account was made and what it did."],
    "account creation": ["Match the account with an approved request.", "Watch the account for new rights."],
    "port scan": ["Find out whether the scanner is ours.", "Check what the probed ports offer."],
}


def normalised_input(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds text, fields and parse_status (structured, text, malformed_json, rejected) for a raw log column.

    A JSON object gives its fields as text (nulls as 'None', as the triage rules expect) and its message, or else
    all values joined by blanks, as text. A blank row is rejected: it stays, marked.
    """
    own = stripped(F.col(raw))
    looks_json = F.startswith(own, F.lit("{")) | F.startswith(own, F.lit("["))
    # only what may be an object is parsed
    braced = F.when(F.startswith(own, F.lit("{")), own)
    parsed = F.from_json(braced, "map<string,string>", {"mode": "PERMISSIVE", "allowUnquotedControlChars": "false"})
    is_object = F.coalesce(F.when(braced.isNotNull(), F.schema_of_variant(F.try_parse_json(braced)).startswith("OBJECT")), F.lit(False))
    fields = F.when(is_object, F.transform_values(parsed, lambda k, v: F.coalesce(v, F.lit("None")))).otherwise(F.create_map().cast("map<string,string>"))
    status = F.when(F.coalesce(own, F.lit("")) == "", "rejected").when(is_object, "structured").when(looks_json, "malformed_json").otherwise("text")
    df = df.withColumns({"fields": fields, "parse_status": status})
    message = F.element_at("fields", "message")
    text = F.when(F.col("parse_status") == "structured", F.coalesce(message, F.array_join(F.map_values("fields"), " "))).otherwise(own)
    return df.withColumn("text", text)


def event_type(text: Column) -> Column:
    """First class whose words occur, of eleven in fixed order."""
    t = F.lower(text)
    ladder = [
        (any_of(t, ["failed password", "invalid user"]), "authentication failure"),
        (any_of(t, ["arp"]) & any_of(t, ["moved from", "is using my ip", "spoof", "poison", "duplicate"]), "arp spoofing"),
        (any_of(t, ["history -c", ".bash_history", "log file cleared"]) | (any_of(t, ["auditd"]) & any_of(t, ["stopped", "disabled"])), "log tampering"),
        (any_of(t, ["group"]) & any_of(t, ["sudo", "wheel", "admin", "adm"]) & any_of(t, ["usermod", "gpasswd", "added"]), "privileged group addition"),
        (any_of(t, ["useradd", "new user", "new account"]), "account creation"),
        (any_of(t, ["nmap", "port scan", "portscan", "masscan"]), "port scan"),
        (any_of(t, ["suricata", "alert"]), "ids alert"),
        (any_of(t, ["blocked", "deny"]), "firewall block"),
        (any_of(t, ["accepted password", "accepted publickey"]), "successful login"),
        (any_of(t, ["connection refused", "timeout"]), "network anomaly"),
    ]
    return reduce(lambda case, x: case.when(*x), ladder[1:], F.when(*ladder[0])).otherwise("unknown security event")


def is_privileged(text: Column, fields: Column) -> Column:
    user = F.lower(F.coalesce(F.element_at(fields, "user"), F.element_at(fields, "account"), F.lit("")))
    return user.isin("root", "administrator", "admin") | F.coalesce(F.rlike(F.lower(text), F.lit(r"\b(?:root|administrator)\b")), F.lit(False))


def severity(kind: Column, privileged: Column, fields: Column) -> Column:
    stated = F.lower(F.coalesce(F.element_at(fields, "severity"), F.lit("")))
    case = F.when(stated.isin(list(BASE_SCORES)), stated)
    for name, (high, low) in ACCOUNT_SEVERITY.items():
        case = case.when(kind == name, F.when(privileged, high).otherwise(low))
    for name, level in PLAIN_SEVERITY.items():
        case = case.when(kind == name, level)
    return case.otherwise("unknown")


def base_score(level: Column) -> Column:
    return reduce(lambda c, x: c.when(level == x[0], x[1]), list(BASE_SCORES.items())[1:], F.when(level == "critical", 90)).otherwise(0)


def severity_score(level: Column, kind: Column, privileged: Column, text: Column) -> Column:
    t = F.lower(text)
    bonus = F.when(privileged, 10).otherwise(0) + F.when((kind == "authentication failure") & any_of(t, ["repeated", "multiple", "brute"]), 10).otherwise(0)
    return F.least(F.lit(100), base_score(level) + bonus + F.when(any_of(t, ["critical"]), 5).otherwise(0)).cast("int")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda x: x != "")


def _unwrapped(token: Column) -> Column:
    return F.regexp_replace(token, r"^[\[\]():;]+|[\[\]():;]+$", "")


def after_from(text: Column) -> Column:
    """Candidates for a source address: tokens after the word from."""
    own = tokens(text)
    return F.filter(F.transform(own, lambda x, i: F.when(F.lower(F.get(own, i - 1)) == "from", _unwrapped(x))), lambda x: x.isNotNull())


def with_source(df: DataFrame) -> DataFrame:
    """Adds source (a structured field as it stands, else the first address after from) and source_valid."""
    given = F.coalesce(*[F.element_at("fields", k) for k in SOURCE_FIELDS])
    near = F.get(F.filter(after_from(F.col("text")), is_ip), F.lit(0))
    df = df.withColumn("source", F.coalesce(given, near))
    return df.withColumn("source_valid", is_ip(F.col("source")))


def indicators(text: Column, fields: Column) -> Column:
    """Structured address fields, or else dotted quads among the tokens; sorted, each once."""
    given = F.array_compact(F.array(*[F.element_at(fields, k) for k in INDICATOR_FIELDS]))
    found = F.filter(F.transform(tokens(text), _unwrapped), is_dotted_quad)
    return F.array_sort(F.array_distinct(F.when(F.size(given) > 0, given).otherwise(found)))


def evidence(text: Column, fields: Column, kind: Column) -> Column:
    """Array of (field, value, meaning)."""

    def row(field: str, value: Column, meaning: str) -> Column:
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(meaning).alias("meaning"))

    given = F.array(*[row(k, F.element_at(fields, k), why) for k, why in EVIDENCE.items()])
    t = F.lower(text)
    plain = F.array(
        row("privileged_account", F.when(any_of(t, ["root", "administrator"]), "root/administrator"), "a privileged account is named"),
        row("event_signal", F.when(kind == "authentication failure", "failed password / invalid user"), "words of a failed login"),
        row("event_signal", F.when(kind == "ids alert", "suricata / alert keyword"), "words of an IDS signature"),
    )
    return F.filter(F.when(F.size(fields) > 0, given).otherwise(plain), lambda x: x["value"].isNotNull())


def recommended_actions(kind: Column, level: Column) -> Column:
    start = F.array(F.lit("Keep the original log."), F.lit("Look at events just before and after."))
    own = reduce(lambda c, x: c.when(kind == x[0], F.array(*map(F.lit, x[1]))), ACTIONS.items(), F.when(F.lit(False), start)).otherwise(F.array().cast("array<string>"))
    return F.concat(start, own, F.when(level.isin("high", "critical"), F.array(F.lit("Have a person look at it now."))).otherwise(F.array().cast("array<string>")))


def triaged(df: DataFrame) -> DataFrame:
    """df (text, fields) with event_type, privileged, severity, severity_score, source, indicators."""
    df = df.withColumn("event_type", event_type(F.col("text"))).withColumn("privileged", is_privileged(F.col("text"), F.col("fields")))
    df = df.withColumn("severity", severity(F.col("event_type"), F.col("privileged"), F.col("fields")))
    df = df.withColumn("severity_score", severity_score(F.col("severity"), F.col("event_type"), F.col("privileged"), F.col("text")))
    return with_source(df).withColumn("indicators", indicators(F.col("text"), F.col("fields")))


def has_all(text: Column, words: list[str]) -> Column:
    return all_of(F.lower(text), words)
