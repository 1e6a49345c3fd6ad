"""The collection record around the payload: source status, warnings, attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbgauge.schemas import SOURCE_STATUS

# Source names, and the path below the payload of the flag behind each.
OS_SOURCES = [("os.basic_metrics", "level0.capability.os_metrics_access")]
MYSQL_SOURCES = [
    ("mysql.global_status", "level0.capability.mysql_status_access"),
    ("mysql.variables", "level0.capability.mysql_variables_access"),
    ("mysql.information_schema", "level0.capability.information_schema_access"),
    ("mysql.replication_status", "level0.capability.replication_status_access"),
]
MYSQL_LOG_SOURCES = [
    ("mysql.slow_log_hot_switch", "level1.capability.can_enable_slow_log_hot_switch"),
    ("mysql.slow_log", "level1.capability.can_read_slow_log"),
    ("mysql.error_log", "level1.capability.can_read_error_log"),
]
PG_LOG_SOURCES = [
    ("postgres.statement_log_hot_switch", "level1.capability.can_enable_slow_log_hot_switch"),
    ("postgres.statement_log", "level1.capability.can_read_slow_log"),
    ("postgres.error_log", "level1.capability.can_read_error_log"),
]
PG_SOURCES = [
    ("postgres.global_status", "postgres_level0.capability.has_status_access"),
    ("postgres.settings", "postgres_level0.capability.has_settings_access"),
    ("postgres.storage", "postgres_level0.capability.has_storage_access"),
    ("postgres.replication_status", "postgres_level0.capability.has_replication_status_access"),
]
CONTRACT_VERSION = "v1"


def _path(root: Column, dotted: str) -> Column:
    for name in dotted.split("."):
        root = root[name]
    return root


def _statuses(payload: Column, sources: Sequence[tuple[str, str]]) -> Column:
    rows = [
        F.struct(F.lit(name).alias("source"), F.coalesce(_path(payload, path), F.lit(False)).alias("ok"))
        for name, path in sources
    ]
    return F.array(*rows)


def source_status(payload: Column) -> Column:
    """Ordered ``source, ok`` array of a payload; empty for a NULL payload."""
    none = F.array().cast(SOURCE_STATUS)

    def part(present: Column, sources: Sequence[tuple[str, str]]) -> Column:
        return F.when(present, _statuses(payload, sources)).otherwise(none)

    mysql = payload["engine"] == "mysql"
    postgres = payload["engine"] == "postgres"
    logs = payload["level1"].isNotNull()
    return F.concat(
        part(payload.isNotNull(), OS_SOURCES),
        part(mysql, MYSQL_SOURCES),
        part(logs & postgres, PG_LOG_SOURCES),
        part(logs & ~F.coalesce(postgres, F.lit(False)), MYSQL_LOG_SOURCES),
        part(payload["postgres_level0"].isNotNull(), PG_SOURCES),
    )


def merge_warnings(payload: Column) -> Column:
    """Warnings of level 0, level 1 and PostgreSQL level 0, in this order."""
    none = F.array().cast("array<string>")
    parts = [payload[part]["warnings"] for part in ("level0", "level1", "postgres_level0")]
    return F.concat(*[F.coalesce(part, none) for part in parts])


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """``attempts(run_id, cycle, attempt, duration_ms, status, error)`` to one row per cycle.

    Attempts behind the first ok one do not count. ``error`` is the last error, also of a cycle that
    ended well. The array is as long as the scheduler's retry limit allows. One read and one shuffle of the attempts.
    """
    trace = F.struct(F.col("attempt").cast("int").alias("attempt"), F.col("duration_ms").cast("bigint").alias("duration_ms"), "status", "error")
    traced = attempts.groupBy("run_id", "cycle").agg(
        F.array_sort(F.collect_list(trace)).alias("_all"), F.min(F.when(F.col("status") == "ok", F.col("attempt"))).alias("_first_ok")
    )
    counting = F.filter("_all", lambda a: F.col("_first_ok").isNull() | (a["attempt"] <= F.col("_first_ok")))
    cut = traced.select("run_id", "cycle", counting.alias("attempts"))
    return cut.withColumn("error", F.try_element_at(F.filter("attempts", lambda a: a["error"].isNotNull()), F.lit(-1))["error"])


def assemble_records(attempts: DataFrame, cycles: DataFrame) -> DataFrame:
    """Collection records in contract order.

    ``cycles`` has one row per run and cycle: run_id, cycle, engine, requested_level, schedule,
    start_unix_ms, end_unix_ms and ``payload`` (NULL where no attempt worked).
    """
    payload = F.col("payload")
    folded = cycles.join(fold_attempts(attempts), ["run_id", "cycle"], "left")
    return folded.select(
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        "run_id",
        F.col("cycle").cast("int").alias("cycle"),
        "engine",
        "requested_level",
        F.col("payload.selected_level").alias("selected_level"),
        "schedule",
        F.struct(
            "start_unix_ms",
            "end_unix_ms",
            F.greatest(F.col("end_unix_ms") - F.col("start_unix_ms"), F.lit(0).cast("bigint")).alias("duration_ms"),
        ).alias("window"),
        F.coalesce("attempts", F.array().cast("array<struct<attempt:int,duration_ms:bigint,status:string,error:string>>")).alias("attempts"),
        source_status(payload).alias("source_status"),
        merge_warnings(payload).alias("warnings"),
        F.when(payload.isNotNull(), "ok").otherwise("failed").alias("status"),
        "error",
        "payload",
    )
