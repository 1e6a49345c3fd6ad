"""What each instance can deliver, and the collection level that follows from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Capability flags and the sources that must all have answered for them.
REQUIRED_SOURCES: dict[str, list[str]] = {
    "mysql_connected": ["mysql.connect"],
    "mysql_status_access": ["mysql.global_status"],
    "mysql_variables_access": ["mysql.variables"],
    "information_schema_access": ["mysql.tables", "mysql.indexes"],
    "replication_status_access": ["mysql.replication_status"],
    "postgres_connected": ["postgres.connect"],
    "has_status_access": ["postgres.global_status"],
    "has_settings_access": ["postgres.settings"],
    "has_storage_access": ["postgres.tables", "postgres.indexes"],
    "has_replication_status_access": ["postgres.replication_status"],
    "can_enable_slow_log_hot_switch": ["slow_log.threshold", "slow_log.enable"],
    "can_read_slow_log": ["slow_log.read"],
    "can_read_error_log": ["error_log.read"],
}
# Host sources; one that answered is enough.
ANY_SOURCES: dict[str, list[str]] = {
    "os_metrics_access": ["os.proc_cpu", "os.proc_mem", "os.load_average", "os.vmstat", "os.iostat", "os.sar"],
}


def capabilities(results: DataFrame, by: Sequence[str] = ("instance",)) -> DataFrame:
    """``results(<by>, source, ok)`` to one row of boolean flags per instance; a missing source is false.

    A source counts as ok if any of its rows is (the replication query has a fallback).
    """

    def answered(source: str) -> Column:
        return F.coalesce(F.bool_or(F.when(F.col("source") == source, F.col("ok"))), F.lit(False))

    flags = []
    for name, sources in REQUIRED_SOURCES.items():
        flag = answered(sources[0])
        for source in sources[1:]:
            flag = flag & answered(source)
        flags.append(flag.alias(name))
    for name, sources in ANY_SOURCES.items():
        flags.append(F.coalesce(F.bool_or(F.when(F.col("source").isin(sources), F.col("ok"))), F.lit(False)).alias(name))
    return results.groupBy(*by).agg(*flags)


# The flags of a probe; the last seven belong to levels no collector fills yet.
PROBE_FLAGS = [
    "has_mysql_status_access",
    "has_mysql_variables_access",
    "has_information_schema_access",
    "has_replication_status_access",
    "has_os_metrics_access",
    "can_enable_slow_log_hot_switch",
    "can_read_slow_log",
    "can_read_error_log",
    "performance_schema_enabled",
    "has_performance_schema_access",
    "has_sys_schema_access",
    "can_capture_tcpdump_short_window",
    "can_capture_perf_short_window",
    "can_capture_strace_short_window",
    "can_sample_innodb_status_high_frequency",
]
# Probe flag, the capability it comes from on MySQL, and on PostgreSQL.
_PROBE_SOURCES = [
    ("has_mysql_status_access", "mysql_status_access", "has_status_access"),
    ("has_mysql_variables_access", "mysql_variables_access", "has_settings_access"),
    ("has_information_schema_access", "information_schema_access", "has_storage_access"),
    ("has_replication_status_access", "replication_status_access", "has_replication_status_access"),
    ("has_os_metrics_access", "os_metrics_access", "os_metrics_access"),
    ("can_enable_slow_log_hot_switch", "can_enable_slow_log_hot_switch", "can_enable_slow_log_hot_switch"),
    ("can_read_slow_log", "can_read_slow_log", "can_read_slow_log"),
    ("can_read_error_log", "can_read_error_log", "can_read_error_log"),
]


def build_probes(capability_rows: DataFrame, keys: Sequence[str] = ("instance",)) -> DataFrame:
    """Capability flags (with ``engine``) to the engine-neutral probe flags; NULL is false."""
    mysql = F.col("engine") == "mysql"
    filled = {
        flag: F.coalesce(F.when(mysql, F.col(on_mysql)).otherwise(F.col(on_pg)), F.lit(False))
        for flag, on_mysql, on_pg in _PROBE_SOURCES
    }
    return capability_rows.select(
        *keys, "engine", *[filled.get(flag, F.lit(False)).alias(flag) for flag in PROBE_FLAGS]
    )


@dataclass(frozen=True)
class Policy:
    """Level wishes. The default prefers the highest level and accepts up to level 2."""

    preferred_level: int = 3
    max_accepted_level: int = 2
    expert_mode_enabled: bool = False


def level_label(level: Column) -> Column:
    return F.concat(F.lit("Level "), level.cast("string"))


# Per level, the flag that must be true and the reason given where it is not.
LEVEL_REASONS: dict[int, list[tuple[str, str]]] = {
    0: [
        ("has_mysql_status_access", "missing SHOW GLOBAL STATUS access"),
        ("has_mysql_variables_access", "missing SHOW VARIABLES access"),
        ("has_information_schema_access", "missing INFORMATION_SCHEMA access"),
        ("has_replication_status_access", "missing replication status access"),
        ("has_os_metrics_access", "missing OS-level metrics access (/proc, vmstat, iostat, sar)"),
    ],
    1: [
        ("can_enable_slow_log_hot_switch", "cannot hot-enable slow log"),
        ("can_read_slow_log", "cannot collect slow log for digest aggregation"),
        ("can_read_error_log", "cannot collect error log"),
    ],
    2: [
        ("performance_schema_enabled", "performance_schema is disabled"),
        ("has_performance_schema_access", "missing performance_schema read access"),
    ],
    3: [
        ("expert_mode_enabled", "expert mode is disabled by policy"),
        ("can_sample_innodb_status_high_frequency", "cannot sample InnoDB status at high frequency"),
        ("has_deep_sampler", "no short-window deep sampler available (tcpdump/perf/strace)"),
    ],
}
# Flags of which one is enough for a deep sampler.
DEEP_SAMPLERS = ["can_capture_tcpdump_short_window", "can_capture_perf_short_window", "can_capture_strace_short_window"]
# Reasons that read differently on PostgreSQL.
PG_REASONS = {
    "missing SHOW GLOBAL STATUS access": "missing pg_stat_database access",
    "missing SHOW VARIABLES access": "missing pg_settings access",
    "missing INFORMATION_SCHEMA access": "missing relation/index metadata access",
    "missing replication status access": "missing pg_stat_replication/pg_stat_wal_receiver access",
    "cannot hot-enable slow log": "cannot hot-enable log_min_duration_statement (ALTER SYSTEM + reload)",
    "cannot collect slow log for digest aggregation": "cannot collect statement log for digest aggregation",
    "cannot collect error log": "cannot collect PostgreSQL log alerts",
}
# Level, name, source and purpose of the collection tasks.
TASKS = [
    (0, "global_status", "SHOW GLOBAL STATUS", "Capture throughput/latency/error counters"),
    (0, "global_variables", "SHOW VARIABLES", "Capture runtime settings and limits"),
    (0, "schema_storage", "INFORMATION_SCHEMA.TABLES/STATISTICS", "Collect table size and index layout"),
    (0, "replication_status", "SHOW REPLICA/SLAVE STATUS", "Observe replication health and lag"),
    (0, "os_basic_metrics", "/proc + vmstat/iostat/sar", "Capture CPU, memory, IO pressure"),
    (1, "slow_log_window", "slow_query_log", "Collect slow SQL with threshold and time window"),
    (1, "slow_log_digest", "slow_query_log digest", "Aggregate similar SQL fingerprints"),
    (1, "error_log_alerts", "error log", "Detect deadlock/crash recovery/purge/replication alerts"),
    (
        2,
        "statement_summary",
        "performance_schema.events_statements_summary_by_digest",
        "Track SQL latency and digest-level hotspots",
    ),
    (2, "wait_events", "performance_schema wait event tables", "Attribute CPU/IO/lock wait bottlenecks"),
    (2, "metadata_locks", "performance_schema.metadata_locks", "Find metadata lock contention"),
    (2, "transaction_lock_views", "performance_schema", "Correlate transaction and lock wait chains"),
    (2, "sys_schema_helpers", "sys schema", "Use pre-joined lock and statement diagnostic views"),
    (3, "tcpdump_short_window", "tcpdump", "Capture packet-level anomalies in short windows"),
    (3, "perf_or_strace_short_window", "perf/strace", "Capture syscall and CPU hotspots in short windows"),
    (3, "innodb_status_hf", "SHOW ENGINE INNODB STATUS", "High-frequency sampling for expert diagnostics"),
]
# Fixed value: the task that needs access to the sys schema.
SYS_TASK = "sys_schema_helpers"


def _any(names: Sequence[str]) -> Column:
    hit = F.col(names[0])
    for name in names[1:]:
        hit = hit | F.col(name)
    return hit


def negotiate(probes: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Evaluate the levels of each probe row and select the highest that holds.

    Adds ``evaluations`` (array of level, label, ok, reasons; highest first, up to the target level;
    a level also carries the reasons of the levels below it), ``selected_level_no`` and
    ``selected_level``. ``policy=None`` reads the columns preferred_level, max_accepted_level and
    expert_mode_enabled of the rows. A projection; no shuffle.
    """
    if policy is None:
        target = F.least("preferred_level", "max_accepted_level")
        expert = F.col("expert_mode_enabled")
    else:
        target = F.lit(min(policy.preferred_level, policy.max_accepted_level))
        expert = F.lit(policy.expert_mode_enabled)
    conditions = {"expert_mode_enabled": expert, "has_deep_sampler": _any(DEEP_SAMPLERS)}

    def own_reasons(level: int) -> Column:
        missing = [
            F.when(~F.coalesce(conditions[flag] if flag in conditions else F.col(flag), F.lit(False)), F.lit(text))
            for flag, text in LEVEL_REASONS[level]
        ]
        return F.array_compact(F.array(*missing))

    judged = probes.withColumn("_reasons_0", own_reasons(0))
    for level in range(1, 4):
        judged = judged.withColumn(f"_reasons_{level}", F.concat(F.col(f"_reasons_{level - 1}"), own_reasons(level)))
    steps = [
        F.struct(
            F.lit(level).alias("level_no"),
            F.lit(f"Level {level}").alias("level"),
            (F.size(f"_reasons_{level}") == 0).alias("ok"),
            F.col(f"_reasons_{level}").alias("reasons"),
        )
        for level in range(3, -1, -1)
    ]
    evaluations = F.filter(F.array(*steps), lambda step: step["level_no"] <= target)
    selected = F.coalesce(F.get(F.filter("evaluations", lambda step: step["ok"]), F.lit(0))["level_no"], F.lit(0))
    return (
        judged.withColumn("evaluations", evaluations)
        .withColumn("selected_level_no", selected)
        .withColumn("selected_level", level_label(F.col("selected_level_no")))
        .drop(*[f"_reasons_{level}" for level in range(4)])
    )


def downgrade_reasons(negotiated: DataFrame) -> DataFrame:
    """Add ``downgrade_reasons``: one ``[Level n] a; b`` text per failed level, in engine wording."""
    wording = F.create_map(*[F.lit(text) for pair in PG_REASONS.items() for text in pair])
    postgres = F.col("engine") == "postgres"

    def worded(reason: Column) -> Column:
        return F.when(postgres, F.coalesce(F.try_element_at(wording, reason), reason)).otherwise(reason)

    def text(step: Column) -> Column:
        return F.concat(F.lit("["), step["level"], F.lit("] "), F.array_join(F.transform(step["reasons"], worded), "; "))

    failed = F.filter("evaluations", lambda step: ~step["ok"])
    return negotiated.withColumn("downgrade_reasons", F.transform(failed, text))


def plan_tasks(negotiated: DataFrame, keys: Sequence[str] = ("instance",)) -> DataFrame:
    """One row per instance and task at or below its selected level.

    The task list is a short constant, so each row unfolds it in place instead of joining it.
    """
    tasks = [
        F.struct(
            F.lit(number).alias("task_no"),
            F.lit(level).alias("level_no"),
            F.lit(f"Level {level}").alias("level"),
            F.lit(name).alias("name"),
            F.lit(source).alias("source"),
            F.lit(purpose).alias("purpose"),
        )
        for number, (level, name, source, purpose) in enumerate(TASKS, start=1)
    ]
    sys_access = F.coalesce("has_sys_schema_access", F.lit(False))
    due = F.filter(
        F.array(*tasks),
        lambda task: (task["level_no"] <= F.col("selected_level_no")) & ((task["name"] != SYS_TASK) | sys_access),
    )
    return negotiated.select(*keys, F.inline(due))
