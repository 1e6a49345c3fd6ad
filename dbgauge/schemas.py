"""Fixed schemas of landed inputs, working tables and the collection record (DDL text)."""

from __future__ import annotations

LINES = "source STRING, block BIGINT, mid BIGINT, line STRING, bytes BIGINT"

ENTRIES = (
    "source STRING, block BIGINT, mid BIGINT, ts TIMESTAMP, sql STRING, query_time_secs DOUBLE, "
    "lock_time_secs DOUBLE, rows_sent BIGINT, rows_examined BIGINT"
)

POSITION = ["source", "block", "mid"]

PAIRS = "instance STRING, pos BIGINT, name STRING, value STRING"

_DIGEST = (
    "STRUCT<fingerprint: STRING, sample_sql: STRING, count: BIGINT, total_query_time_secs: DOUBLE, "
    "avg_query_time_secs: DOUBLE, total_lock_time_secs: DOUBLE, total_rows_sent: BIGINT, total_rows_examined: BIGINT>"
)

_ALERT = "STRUCT<category: STRING, count: BIGINT, sample_lines: ARRAY<STRING>>"

_COMMAND = (
    "STRUCT<command: STRING, args: ARRAY<STRING>, available: BOOLEAN, status_code: INT, output: STRING, error: STRING>"
)

_OS = (
    "STRUCT<proc_cpu: STRUCT<user: BIGINT, nice: BIGINT, system: BIGINT, idle: BIGINT, iowait: BIGINT, irq: BIGINT, "
    "softirq: BIGINT, steal: BIGINT>, "
    "proc_mem: STRUCT<mem_total_kb: BIGINT, mem_available_kb: BIGINT, swap_total_kb: BIGINT, swap_free_kb: BIGINT>, "
    "load_average: STRUCT<one: DOUBLE, five: DOUBLE, fifteen: DOUBLE, running_tasks: STRING, last_pid: BIGINT>, "
    f"vmstat: {_COMMAND}, iostat: {_COMMAND}, sar: {_COMMAND}>"
)

_MYSQL = (
    "STRUCT<global_status: MAP<STRING, STRING>, global_variables: MAP<STRING, STRING>, "
    "table_sizes: ARRAY<STRUCT<table_schema: STRING, table_name: STRING, engine: STRING, table_rows: BIGINT, "
    "data_length: BIGINT, index_length: BIGINT, total_length: BIGINT>>, "
    "indexes: ARRAY<STRUCT<table_schema: STRING, table_name: STRING, index_name: STRING, non_unique: BIGINT, "
    "seq_in_index: BIGINT, column_name: STRING, cardinality: BIGINT>>, "
    "replication_status: MAP<STRING, STRING>, replication_status_source: STRING>"
)

LEVEL0 = (
    "STRUCT<collected_at_unix_ms: BIGINT, capability: STRUCT<mysql_connected: BOOLEAN, mysql_status_access: BOOLEAN, "
    "mysql_variables_access: BOOLEAN, information_schema_access: BOOLEAN, replication_status_access: BOOLEAN, "
    f"os_metrics_access: BOOLEAN>, mysql: {_MYSQL}, os: {_OS}, warnings: ARRAY<STRING>>"
)

_POSTGRES = (
    "STRUCT<global_status: MAP<STRING, STRING>, global_variables: MAP<STRING, STRING>, "
    "table_sizes: ARRAY<STRUCT<table_schema: STRING, table_name: STRING, estimated_rows: BIGINT, data_length: BIGINT, "
    "index_length: BIGINT, total_length: BIGINT>>, "
    "indexes: ARRAY<STRUCT<table_schema: STRING, table_name: STRING, index_name: STRING, index_def: STRING>>, "
    "replication_status: MAP<STRING, STRING>>"
)

POSTGRES_LEVEL0 = (
    "STRUCT<collected_at_unix_ms: BIGINT, capability: STRUCT<postgres_connected: BOOLEAN, has_status_access: BOOLEAN, "
    "has_settings_access: BOOLEAN, has_storage_access: BOOLEAN, has_replication_status_access: BOOLEAN>, "
    f"postgres: {_POSTGRES}, warnings: ARRAY<STRING>>"
)

SLOW_LOG = (
    "STRUCT<enabled_for_window: BOOLEAN, window_secs: BIGINT, long_query_time_secs: DOUBLE, slow_log_path: STRING, "
    "previous_slow_query_log: STRING, previous_long_query_time: STRING, collected_bytes: BIGINT, "
    f"parsed_entries: BIGINT, digest_count: BIGINT, digests: ARRAY<{_DIGEST}>>"
)

ERROR_LOG = (
    f"STRUCT<error_log_path: STRING, sampled_lines: BIGINT, alert_count: BIGINT, alerts: ARRAY<{_ALERT}>>"
)

LEVEL1 = (
    "STRUCT<collected_at_unix_ms: BIGINT, capability: STRUCT<mysql_connected: BOOLEAN, postgres_connected: BOOLEAN, "
    "can_enable_slow_log_hot_switch: BOOLEAN, can_read_slow_log: BOOLEAN, can_read_error_log: BOOLEAN>, "
    f"slow_log: {SLOW_LOG}, error_log: {ERROR_LOG}, warnings: ARRAY<STRING>>"
)

PAYLOAD = (
    "STRUCT<engine: STRING, requested_level: STRING, selected_level: STRING, downgrade_reasons: ARRAY<STRING>, "
    f"level0: {LEVEL0}, postgres_level0: {POSTGRES_LEVEL0}, level1: {LEVEL1}>"
)

SCHEDULE = (
    "STRUCT<mode: STRING, interval_secs: BIGINT, jitter_pct: DOUBLE, timeout_secs: BIGINT, retry_times: INT, "
    "retry_backoff_ms: BIGINT, max_cycles: INT>"
)

ATTEMPTS = "ARRAY<STRUCT<attempt: INT, duration_ms: BIGINT, status: STRING, error: STRING>>"

SOURCE_STATUS = "ARRAY<STRUCT<source: STRING, ok: BOOLEAN>>"

RECORD = (
    "contract_version STRING, run_id STRING, cycle INT, engine STRING, requested_level STRING, selected_level STRING, "
    f"schedule {SCHEDULE}, "
    "window STRUCT<start_unix_ms: BIGINT, end_unix_ms: BIGINT, duration_ms: BIGINT>, "
    f"attempts {ATTEMPTS}, source_status {SOURCE_STATUS}, warnings ARRAY<STRING>, status STRING, error STRING, "
    f"payload {PAYLOAD}"
)

SUMMARY = (
    "file STRING, contract_version STRING, engine STRING, requested_level STRING, selected_level STRING, "
    f"status STRING, source_status {SOURCE_STATUS}, "
    "level1 STRUCT<enabled: BOOLEAN, hot_switch_ok: BOOLEAN, slow_log_ok: BOOLEAN, error_log_ok: BOOLEAN, "
    "digest_count_ge_1: BOOLEAN, alert_categories: ARRAY<STRING>>"
)
