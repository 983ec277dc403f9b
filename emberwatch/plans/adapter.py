"""Test tables as telemetry: events become log lines, and other tables inventories, evidence and ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: event_id, idx, ts, user_id, user, src_ip, sequence_id (address and week), text, raw, fields."""
    e = table(spark, sf_dir, "events")
    user = F.when(F.col("user_id") % 10 == 0, F.lit("root")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    ip = F.concat(F.lit("203.0.113."), (F.col("user_id") % 200).cast("string"))
    e = e.select("event_id", F.col("event_id").alias("idx"), "ts", "user_id", "event_type", "value", user.alias("user"), ip.alias("src_ip"))
    ssh = F.concat(F.lit(" password for "), F.col("user"), F.lit(" from "), F.col("src_ip"), F.lit(" port 22 ssh2"))
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed"), ssh))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Accepted"), ssh))
        .when(F.col("event_type") == "signup", F.concat(F.lit("useradd: new user: name=u"), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("inbound connection blocked from "), F.col("src_ip"), F.lit(" to port 443")))
        .otherwise(F.concat(F.lit("Suricata alert: ET SCAN nmap from "), F.col("src_ip")))
    )
    week = F.datediff(F.col("ts").cast("date"), F.lit("2020-01-06").cast("date"))
    out = e.withColumns({"text": text, "raw": text, "message": text, "fields": F.create_map().cast("map<string,string>"), "parse_status": F.lit("text"), "sequence_id": F.concat_ws("/", "src_ip", F.floor(week / 7).cast("string"))})
    return out.withColumnRenamed("event_type", "action")


#: The same in SQL, as a common table expression named soc.
LOGS_SQL = """
raw_events AS (
  SELECT event_id, event_id AS idx, ts, user_id, event_type AS action, value,
         CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'u' || user_id END AS usr, '203.0.113.' || (user_id % 200) AS src_ip FROM events),
soc0 AS (
  SELECT *, src_ip || '/' || CAST(floor(date_diff('day', DATE '2020-01-06', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS sequence_id,
         CASE action WHEN 'error' THEN 'Failed password for ' || usr || ' from ' || src_ip || ' port 22 ssh2'
                     WHEN 'purchase' THEN 'Accepted password for ' || usr || ' from ' || src_ip || ' port 22 ssh2'
                     WHEN 'signup' THEN 'useradd: new user: name=u' || user_id
                     WHEN 'view' THEN 'inbound connection blocked from ' || src_ip || ' to port 443'
                     ELSE 'Suricata alert: ET SCAN nmap from ' || src_ip END AS text FROM raw_events),
soc1 AS (
  SELECT *, CASE
    WHEN contains(lower(text), 'failed password') OR contains(lower(text), 'invalid user') THEN 'authentication failure'
    WHEN contains(lower(text), 'arp') AND (contains(lower(text), 'moved from') OR contains(lower(text), 'spoof') OR contains(lower(text), 'poison') OR contains(lower(text), 'duplicate')) THEN 'arp spoofing'
    WHEN contains(lower(text), 'history -c') THEN 'log tampering'
    WHEN contains(lower(text), 'useradd') OR contains(lower(text), 'new user') THEN 'account creation'
    WHEN contains(lower(text), 'nmap') OR contains(lower(text), 'port scan') THEN 'port scan'
    WHEN contains(lower(text), 'suricata') OR contains(lower(text), 'alert') THEN 'ids alert'
    WHEN contains(lower(text), 'blocked') OR contains(lower(text), 'deny') THEN 'firewall block'
    WHEN contains(lower(text), 'accepted password') THEN 'successful login'
    ELSE 'unknown security event' END AS event_type,
    regexp_matches(lower(text), '\\b(root|administrator)\\b') AS privileged,
    CASE WHEN contains(text, ' from ') THEN src_ip END AS source FROM soc0),
soc2 AS (
  SELECT *, CASE event_type
    WHEN 'authentication failure' THEN CASE WHEN privileged THEN 'high' ELSE 'medium' END
    WHEN 'successful login' THEN CASE WHEN privileged THEN 'high' ELSE 'low' END
    WHEN 'account creation' THEN 'medium' WHEN 'port scan' THEN 'medium' WHEN 'ids alert' THEN 'medium'
    WHEN 'firewall block' THEN 'low' ELSE 'unknown' END AS severity FROM soc1),
soc AS (
  SELECT *, CAST(least(100, CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 45 WHEN 'low' THEN 20 ELSE 0 END
         + CASE WHEN privileged THEN 10 ELSE 0 END) AS INTEGER) AS severity_score,
         CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 45 WHEN 'low' THEN 20 ELSE 0 END AS base FROM soc2)
"""
