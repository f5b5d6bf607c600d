"""Queries of the general problems: changed records, drifting schemas, mixed timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.instants import instant_millis
from siftlake.operators.changes import consume_scans
from siftlake.operators.drift import consistent_table, schema_changes
from siftlake.plans.session import table, work_folder


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return consume_scans(table(spark, sf, "scan_entries"), table(spark, sf, "sync_runs"), table(spark, sf, "collections"), work_folder(spark, "scans"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "session_exports"))


def p4_table(table_name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The records of one table_name of all export files as one table."""
    return lambda spark, sf: consistent_table(table(spark, sf, "session_exports"), table_name)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    machines = table(spark, sf, "machines", "machine_id", "tz_name", "date_order").dropDuplicates(["machine_id"])
    sessions = table(spark, sf, "sessions", "session_id", "machine_id", "cursor_value").join(machines, "machine_id", "left")
    utc = instant_millis(F.col("cursor_value"), F.col("tz_name"), F.col("date_order"))
    return sessions.select("session_id", utc.alias("utc_ms")).filter("utc_ms IS NOT NULL AND session_id IS NOT NULL").distinct()


#: The values of session_exports.table_name.
EXPORTED = ("session", "message", "part", "image")

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, **{f"p4_{t}_table": p4_table(t) for t in EXPORTED}, "p7_found": p7_found}

ORACLE: dict[str, str] = {}
