"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_data, queries_mixed, queries_more, queries_scans, queries_security, queries_whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries_security.QUERIES | queries_data.QUERIES | queries_more.QUERIES | queries_whole.QUERIES | queries_scans.QUERIES | queries_mixed.QUERIES
ORACLE_SQL: dict[str, str] = queries_security.ORACLE_SQL | queries_data.ORACLE_SQL | queries_more.ORACLE_SQL | queries_whole.ORACLE_SQL | queries_scans.ORACLE_SQL | queries_mixed.ORACLE_SQL
