"""Queries over capability flags and level negotiation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.operators.capability import build_probes, capabilities, downgrade_reasons, negotiate, plan_tasks
from dbgauge.plans.inputs import table

# Fixed values, stated here once more so that inputs and expected rows do not follow the operators: sources and probe flags.
SOURCES = (
    "mysql.connect mysql.global_status mysql.variables mysql.tables mysql.indexes mysql.replication_status "
    "postgres.connect postgres.global_status postgres.settings postgres.tables postgres.indexes postgres.replication_status "
    "slow_log.threshold slow_log.enable slow_log.read error_log.read "
    "os.proc_cpu os.proc_mem os.load_average os.vmstat os.iostat os.sar"
).split()
FLAGS = (
    "has_mysql_status_access has_mysql_variables_access has_information_schema_access has_replication_status_access has_os_metrics_access "
    "can_enable_slow_log_hot_switch can_read_slow_log can_read_error_log performance_schema_enabled has_performance_schema_access "
    "has_sys_schema_access can_capture_tcpdump_short_window can_capture_perf_short_window can_capture_strace_short_window "
    "can_sample_innodb_status_high_frequency"
).split()


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances; which sources answered, or were tried at all, follows from the key."""
    key = F.col("c_custkey")
    tried = F.array(*[
        F.when((key + number) % 11 != 0, F.struct(F.lit(name).alias("source"), ((key * 7 + number * 13) % 9 != 0).alias("ok")))
        for number, name in enumerate(SOURCES)
    ])
    return table(spark, sf_dir, "customer").select(
        key.alias("instance"),
        F.when(key % 2 == 0, "mysql").otherwise("postgres").alias("engine"),
        F.inline(F.array_compact(tried)),
    )


def capability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capabilities(_results(spark, sf_dir), ["instance", "engine"])


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_probes(capability_rollup(spark, sf_dir))


def _probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with mostly true flags and their own policy."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("instance"),
        F.when(key % 2 == 0, "mysql").otherwise("postgres").alias("engine"),
        *[((key + number * 5) % 29 != 0).alias(flag) for number, flag in enumerate(FLAGS)],
        (key % 4).alias("preferred_level"),
        F.floor(key / 4 % 4).alias("max_accepted_level"),
        (key % 3 != 0).alias("expert_mode_enabled"),
    )


def negotiated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negotiate(_probe_rows(spark, sf_dir))
    return rows.select("instance", "selected_level", F.inline("evaluations")).select(
        "instance", "selected_level", "level", "ok", F.array_join("reasons", "; ").alias("reasons")
    )


def downgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = downgrade_reasons(negotiate(_probe_rows(spark, sf_dir)))
    return rows.select("instance", "selected_level", F.array_join("downgrade_reasons", " | ").alias("downgrade_reasons"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_tasks(negotiate(_probe_rows(spark, sf_dir))).select("instance", "level", "name", "source", "purpose")


QUERIES = {
    "capabilities": capability_rollup,
    "build_probes": probes,
    "negotiate": negotiated_levels,
    "downgrade_reasons": downgrades,
    "plan_tasks": tasks,
}


# Expected rows, from literals only.
_CAPABILITIES = """
WITH a AS (
  SELECT c_custkey, list_transform(range(0, 22), lambda n: (c_custkey + n) % 11 <> 0 AND (c_custkey * 7 + n * 13) % 9 <> 0) AS ok FROM customer
), c AS (
  SELECT c_custkey AS instance, CASE WHEN c_custkey % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS engine,
    ok[1] AS mysql_connected, ok[2] AS mysql_status_access, ok[3] AS mysql_variables_access, ok[4] AND ok[5] AS information_schema_access,
    ok[6] AS replication_status_access, ok[7] AS postgres_connected, ok[8] AS has_status_access, ok[9] AS has_settings_access,
    ok[10] AND ok[11] AS has_storage_access, ok[12] AS has_replication_status_access, ok[13] AND ok[14] AS can_enable_slow_log_hot_switch,
    ok[15] AS can_read_slow_log, ok[16] AS can_read_error_log, ok[17] OR ok[18] OR ok[19] OR ok[20] OR ok[21] OR ok[22] AS os_metrics_access
  FROM a
)"""
_PROBES = _CAPABILITIES + """
SELECT instance, engine, CASE engine WHEN 'mysql' THEN mysql_status_access ELSE has_status_access END AS has_mysql_status_access,
  CASE engine WHEN 'mysql' THEN mysql_variables_access ELSE has_settings_access END AS has_mysql_variables_access,
  CASE engine WHEN 'mysql' THEN information_schema_access ELSE has_storage_access END AS has_information_schema_access,
  CASE engine WHEN 'mysql' THEN replication_status_access ELSE has_replication_status_access END AS has_replication_status_access,
  os_metrics_access AS has_os_metrics_access, can_enable_slow_log_hot_switch, can_read_slow_log, can_read_error_log,
  false AS performance_schema_enabled, false AS has_performance_schema_access, false AS has_sys_schema_access,
  false AS can_capture_tcpdump_short_window, false AS can_capture_perf_short_window, false AS can_capture_strace_short_window,
  false AS can_sample_innodb_status_high_frequency
FROM c"""
# Level, number of the flag in FLAGS (15: expert mode, 16: any deep sampler), reason, reason on PostgreSQL.
_REASONS = """
  (0, 0, 'missing SHOW GLOBAL STATUS access', 'missing pg_stat_database access'),
  (0, 1, 'missing SHOW VARIABLES access', 'missing pg_settings access'),
  (0, 2, 'missing INFORMATION_SCHEMA access', 'missing relation/index metadata access'),
  (0, 3, 'missing replication status access', 'missing pg_stat_replication/pg_stat_wal_receiver access'),
  (0, 4, 'missing OS-level metrics access (/proc, vmstat, iostat, sar)', 'missing OS-level metrics access (/proc, vmstat, iostat, sar)'),
  (1, 5, 'cannot hot-enable slow log', 'cannot hot-enable log_min_duration_statement (ALTER SYSTEM + reload)'),
  (1, 6, 'cannot collect slow log for digest aggregation', 'cannot collect statement log for digest aggregation'),
  (1, 7, 'cannot collect error log', 'cannot collect PostgreSQL log alerts'),
  (2, 8, 'performance_schema is disabled', 'performance_schema is disabled'),
  (2, 9, 'missing performance_schema read access', 'missing performance_schema read access'),
  (3, 15, 'expert mode is disabled by policy', 'expert mode is disabled by policy'),
  (3, 14, 'cannot sample InnoDB status at high frequency', 'cannot sample InnoDB status at high frequency'),
  (3, 16, 'no short-window deep sampler available (tcpdump/perf/strace)', 'no short-window deep sampler available (tcpdump/perf/strace)')"""
_LEVELS = f"""
WITH f AS (
  SELECT c_custkey AS instance, least(c_custkey % 4, c_custkey // 4 % 4) AS target,
    list_transform(range(0, 15), lambda n: (c_custkey + n * 5) % 29 <> 0) AS flags FROM customer
), p AS (
  SELECT instance, target, flags[11] AS sys_access, flags || [instance % 3 <> 0, flags[12] OR flags[13] OR flags[14]] AS flags FROM f
), q(level, flag, text, pg_text) AS (VALUES {_REASONS}
), m AS (SELECT instance, level, text, pg_text, flag FROM p JOIN q ON NOT flags[flag + 1]),
o AS (SELECT *, CASE flag WHEN 15 THEN 13 WHEN 14 THEN 14 WHEN 16 THEN 15 ELSE flag END AS place FROM m),
e AS (
  SELECT p.instance, l.level_no, any_value(sys_access) AS sys_access, coalesce(string_agg(text, '; ' ORDER BY place), '') AS reasons,
    coalesce(string_agg(pg_text, '; ' ORDER BY place), '') AS pg_reasons
  FROM p JOIN (VALUES (0), (1), (2), (3)) l(level_no) ON l.level_no <= target LEFT JOIN o ON o.instance = p.instance AND o.level <= l.level_no GROUP BY 1, 2
), s AS (SELECT instance, coalesce(max(level_no) FILTER (WHERE reasons = ''), 0) AS selected, any_value(sys_access) AS sys_access FROM e GROUP BY 1)"""
# Level, name, source and purpose of the collection tasks.
_TASKS = """
  (0, 'global_status', 'SHOW GLOBAL STATUS', 'Capture throughput/latency/error counters'),
  (0, 'global_variables', 'SHOW VARIABLES', 'Capture runtime settings and limits'),
  (0, 'schema_storage', 'INFORMATION_SCHEMA.TABLES/STATISTICS', 'Collect table size and index layout'),
  (0, 'replication_status', 'SHOW REPLICA/SLAVE STATUS', 'Observe replication health and lag'),
  (0, 'os_basic_metrics', '/proc + vmstat/iostat/sar', 'Capture CPU, memory, IO pressure'),
  (1, 'slow_log_window', 'slow_query_log', 'Collect slow SQL with threshold and time window'),
  (1, 'slow_log_digest', 'slow_query_log digest', 'Aggregate similar SQL fingerprints'),
  (1, 'error_log_alerts', 'error log', 'Detect deadlock/crash recovery/purge/replication alerts'),
  (2, 'statement_summary', 'performance_schema.events_statements_summary_by_digest', 'Track SQL latency and digest-level hotspots'),
  (2, 'wait_events', 'performance_schema wait event tables', 'Attribute CPU/IO/lock wait bottlenecks'),
  (2, 'metadata_locks', 'performance_schema.metadata_locks', 'Find metadata lock contention'),
  (2, 'transaction_lock_views', 'performance_schema', 'Correlate transaction and lock wait chains'),
  (2, 'sys_schema_helpers', 'sys schema', 'Use pre-joined lock and statement diagnostic views'),
  (3, 'tcpdump_short_window', 'tcpdump', 'Capture packet-level anomalies in short windows'),
  (3, 'perf_or_strace_short_window', 'perf/strace', 'Capture syscall and CPU hotspots in short windows'),
  (3, 'innodb_status_hf', 'SHOW ENGINE INNODB STATUS', 'High-frequency sampling for expert diagnostics')"""

ORACLES = {
    "capabilities": _CAPABILITIES + " SELECT * FROM c",
    "build_probes": _PROBES,
    "negotiate": _LEVELS + " SELECT instance, 'Level ' || selected AS selected_level, 'Level ' || level_no AS level, reasons = '' AS ok, reasons FROM e JOIN s USING (instance)",
    "downgrade_reasons": _LEVELS + """
SELECT instance, 'Level ' || any_value(selected) AS selected_level, coalesce(string_agg('[Level ' || level_no || '] ' ||
  CASE WHEN instance % 2 = 0 THEN reasons ELSE pg_reasons END, ' | ' ORDER BY level_no DESC) FILTER (WHERE reasons <> ''), '') AS downgrade_reasons
FROM e JOIN s USING (instance) GROUP BY instance""",
    "plan_tasks": _LEVELS + f""", t(level_no, name, source, purpose) AS (VALUES {_TASKS}
) SELECT instance, 'Level ' || level_no AS level, name, source, purpose FROM s JOIN t ON level_no <= selected WHERE name <> 'sys_schema_helpers' OR sys_access""",
}
