"""Queries over collection records: assembly, contract, summaries, budgets, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.operators.checks import (
    MATRIX_RULES,
    RESILIENCE_RULES,
    assert_records,
    check_budgets,
    diff_in_order,
    diff_summaries,
    first_failure,
    numbered,
    summarize_records,
)
from dbgauge.operators.capability import PROBE_FLAGS, Policy, downgrade_reasons, negotiate
from dbgauge.operators.contract import validate_records
from dbgauge.operators.envelope import assemble_records, merge_warnings, source_status
from dbgauge.plans.inputs import spread, table
from dbgauge.schemas import PAYLOAD, SCHEDULE
from dbgauge.session import scratch_path
from dbgauge.sources.records import read_records, typed_records, with_variant, write_records


def _named(**columns: Column) -> Column:
    return F.struct(*[column.alias(name) for name, column in columns.items()])


def _number(value: int | float) -> Column:
    return F.lit(value)


def _texts(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _command(name: str) -> Column:
    return _named(
        command=F.lit(name),
        args=_texts(),
        available=F.lit(False),
        status_code=F.lit(None).cast("int"),
        output=F.lit(None).cast("string"),
        error=F.lit("command not found"),
    )


def _schedule() -> Column:
    return _named(
        mode=F.lit("once"),
        interval_secs=_number(60),
        jitter_pct=_number(0.1),
        timeout_secs=_number(120),
        retry_times=_number(1),
        retry_backoff_ms=_number(1000),
        max_cycles=F.lit(None).cast("int"),
    ).cast(SCHEDULE)


# Three alert categories per instance at most, with a repeated one, by ``key % 4``.
_CATEGORIES = {1: ["purge", "deadlock", "purge"], 2: ["replication"], 3: ["deadlock", "crash_recovery"]}


def _alert_array(key: Column) -> Column:
    item = "struct<category:string,count:bigint,sample_lines:array<string>>"

    def rows(names: list[str]) -> Column:
        return F.array(*[_named(category=F.lit(name), count=_number(1), sample_lines=_texts(F.lit(name))) for name in names]).cast(f"array<{item}>")

    chosen = F.when(key % 4 == 0, F.array().cast(f"array<{item}>"))
    for remainder, names in _CATEGORIES.items():
        chosen = chosen.when(key % 4 == remainder, rows(names))
    return chosen


def _payload(key: Column, engine: Column, level1: Column) -> Column:
    """A whole payload whose flags follow from ``key``."""
    postgres = engine == "postgres"
    none = F.lit(None)
    level = F.when(level1, "Level 1").otherwise("Level 0")
    text = key.cast("string")
    level0 = _named(
        collected_at_unix_ms=key,
        capability=_named(
            mysql_connected=~postgres,
            mysql_status_access=(key + 1) % 7 != 0,
            mysql_variables_access=(key + 2) % 7 != 0,
            information_schema_access=(key + 3) % 7 != 0,
            replication_status_access=(key + 4) % 7 != 0,
            os_metrics_access=(key + 5) % 7 != 0,
        ),
        mysql=_named(
            global_status=F.create_map(F.lit("Uptime"), text),
            global_variables=F.create_map(F.lit("version"), F.lit("8.0")),
            table_sizes=F.array(_named(
                table_schema=F.lit("app"), table_name=F.lit("orders"), engine=F.lit("InnoDB"), table_rows=key,
                data_length=key, index_length=key, total_length=key * 2,
            )),
            indexes=F.array(_named(
                table_schema=F.lit("app"), table_name=F.lit("orders"), index_name=F.lit("PRIMARY"), non_unique=_number(0),
                seq_in_index=_number(1), column_name=F.lit("id"), cardinality=key,
            )),
            replication_status=none.cast("map<string,string>"),
            replication_status_source=F.lit("SHOW REPLICA STATUS"),
        ),
        os=_named(
            proc_cpu=_named(**{name: key for name in ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")}),
            proc_mem=_named(**{name: key for name in ("mem_total_kb", "mem_available_kb", "swap_total_kb", "swap_free_kb")}),
            load_average=_named(one=_number(0.1), five=_number(0.2), fifteen=_number(0.3), running_tasks=F.lit("1/2"), last_pid=key),
            vmstat=_command("vmstat"),
            iostat=_command("iostat"),
            sar=_command("sar"),
        ),
        warnings=F.when(key % 2 == 0, _texts(F.concat(F.lit("level0 "), text))).otherwise(_texts()),
    )
    postgres_level0 = _named(
        collected_at_unix_ms=key,
        capability=_named(
            postgres_connected=F.lit(True),
            has_status_access=(key + 1) % 5 != 0,
            has_settings_access=(key + 2) % 5 != 0,
            has_storage_access=(key + 3) % 5 != 0,
            has_replication_status_access=(key + 4) % 5 != 0,
        ),
        postgres=_named(
            global_status=F.create_map(F.lit("deadlocks"), text),
            global_variables=F.create_map(F.lit("version"), F.lit("16")),
            table_sizes=F.array().cast(
                "array<struct<table_schema:string,table_name:string,estimated_rows:bigint,data_length:bigint,index_length:bigint,total_length:bigint>>"
            ),
            indexes=F.array().cast("array<struct<table_schema:string,table_name:string,index_name:string,index_def:string>>"),
            replication_status=F.create_map(F.lit("is_in_recovery"), F.lit("false")),
        ),
        warnings=_texts(F.lit("postgres level0")),
    )
    logs = _named(
        collected_at_unix_ms=key,
        capability=_named(
            mysql_connected=~postgres,
            postgres_connected=postgres,
            can_enable_slow_log_hot_switch=(key + 1) % 3 != 0,
            can_read_slow_log=(key + 2) % 3 != 0,
            can_read_error_log=key % 3 != 0,
        ),
        slow_log=_named(
            enabled_for_window=F.lit(True),
            window_secs=_number(5),
            long_query_time_secs=_number(0.1),
            slow_log_path=F.lit("/log/slow.log"),
            previous_slow_query_log=none.cast("string"),
            previous_long_query_time=F.lit("10.0"),
            collected_bytes=key,
            parsed_entries=key % 3,
            digest_count=key % 3,
            digests=F.array().cast(
                "array<struct<fingerprint:string,sample_sql:string,count:bigint,total_query_time_secs:double,avg_query_time_secs:double,"
                "total_lock_time_secs:double,total_rows_sent:bigint,total_rows_examined:bigint>>"
            ),
        ),
        error_log=_named(error_log_path=none.cast("string"), sampled_lines=key, alert_count=F.size(_alert_array(key)), alerts=_alert_array(key)),
        warnings=_texts(F.lit("level1 a"), F.lit("level1 b")),
    )
    return _named(
        engine=engine,
        requested_level=level,
        selected_level=level,
        downgrade_reasons=_texts(),
        level0=level0,
        postgres_level0=F.when(postgres, postgres_level0),
        level1=F.when(level1, logs),
    ).cast(PAYLOAD)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collection records with ``file`` and ``file_size``; every 17th one failed."""
    key = F.col("o_orderkey")
    engine = F.when(key % 3 == 0, "postgres").otherwise("mysql")
    level1 = key % 2 == 1
    failed = key % 17 == 0
    level = F.when(level1, "Level 1").otherwise("Level 0")
    duration = (key * 37) % 20_000
    payload = F.when(~failed, _payload(key, engine, level1))
    narrow = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    rows = narrow.select("o_orderkey", "o_totalprice", payload.alias("payload"))
    return rows.select(
        F.concat(engine, F.lit("_"), key.cast("string"), F.when(level1, "_level1.json").otherwise("_level0.json")).alias("file"),
        F.floor(F.col("o_totalprice") * 20).alias("file_size"),
        F.lit("v1").alias("contract_version"),
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        F.lit(1).alias("cycle"),
        engine.alias("engine"),
        level.alias("requested_level"),
        F.col("payload.selected_level").alias("selected_level"),
        _schedule().alias("schedule"),
        _named(start_unix_ms=key, end_unix_ms=key + duration, duration_ms=duration).alias("window"),
        F.array(_named(
            attempt=_number(1), duration_ms=duration, status=F.when(failed, "failed").otherwise("ok"),
            error=F.when(failed, "collection timed out after 1000ms"),
        )).alias("attempts"),
        source_status(F.col("payload")).alias("source_status"),
        merge_warnings(F.col("payload")).alias("warnings"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, "collection timed out after 1000ms").alias("error"),
        "payload",
    )


_DEFECTS = 20


def _damaged(text: Column, key: Column) -> Column:
    """JSON text with one defect by ``key % 20``; from 11 on it stays valid (11 has a whole 1.0)."""

    def swap(old: str, new: str) -> Column:
        return F.replace(text, F.lit(old), F.lit(new))

    kind = key % _DEFECTS
    return (
        F.when(kind == 0, swap('"cycle":1,', '"cycle":0,'))
        .when(kind == 1, swap('"contract_version":"v1"', '"contract_version":"v2"'))
        .when(kind == 2, swap('"run_id":', '"run":'))
        .when(kind == 3, swap('"jitter_pct":0.1', '"jitter_pct":"high"'))
        .when(kind == 4, F.regexp_replace(text, r'"attempts":\[\{"attempt":1,', '"attempts":[{"attempt":1.5,'))
        .when(kind == 5, F.regexp_replace(text, r'"proc_cpu":\{[^}]*\}', '"proc_cpu":null'))
        .when(kind == 6, F.left(text, F.length(text) - 1))
        .when(kind == 7, swap('"mode":"once"', '"mode":7'))
        .when(kind == 8, F.regexp_replace(text, r'"warnings":\[[^\]]*\],"status"', '"warnings":["a",7],"status"'))
        .when(kind == 9, F.regexp_replace(text, r'"payload":.*\z', '"payload":[]}'))
        .when(kind == 10, F.regexp_replace(text, r'"start_unix_ms":\d+', '"start_unix_ms":-1'))
        .when(kind == 11, swap('"cycle":1,', '"cycle":1.0,'))
        .otherwise(text)
    )


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir)
    fields = [name for name in records.columns if name not in ("file", "file_size")]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    key = F.regexp_extract("file", r"_(\d+)_", 1).cast("bigint")
    landed = records.select("file", _damaged(text, key).alias("text"))
    return validate_records(with_variant(landed))


def _shown(summaries: DataFrame) -> DataFrame:
    statuses = F.transform("source_status", lambda s: F.concat_ws("=", s["source"], s["ok"].cast("string")))
    return summaries.select(
        "file",
        "contract_version",
        "engine",
        "requested_level",
        "selected_level",
        "status",
        F.array_join(statuses, "|").alias("source_status"),
        F.col("level1.enabled").alias("enabled"),
        F.col("level1.hot_switch_ok").alias("hot_switch_ok"),
        F.col("level1.slow_log_ok").alias("slow_log_ok"),
        F.col("level1.error_log_ok").alias("error_log_ok"),
        F.col("level1.digest_count_ge_1").alias("digest_count_ge_1"),
        F.array_join("level1.alert_categories", "|").alias("alert_categories"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(summarize_records(order_records(spark, sf_dir)))


def summary_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected summaries have another status for every 50th record and lack every 60th."""
    actual = summarize_records(order_records(spark, sf_dir))
    key = F.regexp_extract("file", r"_(\d+)_", 1).cast("bigint")
    expected = actual.filter(key % 60 != 7).withColumn("status", F.when(key % 50 == 0, "late").otherwise(F.col("status")))
    return diff_summaries(actual, expected).select("difference", "file", "status")


def ordered_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected summaries are those found, but two of each hundred neighbours have changed places."""
    actual = numbered(summarize_records(order_records(spark, sf_dir)), "file")
    place = F.col("position") % 100
    expected = actual.withColumn("position", F.col("position") + F.when(place == 3, 1).when(place == 4, -1).otherwise(0))
    return diff_in_order(actual, expected).select("position", "difference", "file", "status")


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_budgets(order_records(spark, sf_dir))


def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_failure(check_budgets(order_records(spark, sf_dir))).select("file", "failure")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assert_records(order_records(spark, sf_dir), MATRIX_RULES)


def resilience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cycles that timed out or lost log access; levels and reasons come from negotiation."""
    key = F.col("o_orderkey")
    flags = {name: F.lit(True) for name in PROBE_FLAGS}
    for number, name in enumerate(["can_enable_slow_log_hot_switch", "can_read_slow_log", "can_read_error_log"]):
        flags[name] = (key + number) % 5 == 0
    timed_out = key % 3 == 0
    engine = F.when(key % 3 == 2, "postgres").otherwise("mysql")
    probes = table(spark, sf_dir, "orders").select(key, engine.alias("engine"), *[flag.alias(name) for name, flag in flags.items()])
    levels = downgrade_reasons(negotiate(probes, Policy(1, 1)))
    tries = F.when(key % 4 == 0, 2).otherwise(3)
    failures = F.transform(F.sequence(F.lit(1), tries), lambda n: _named(attempt=n, duration_ms=F.lit(1000).cast("bigint"), status=F.lit("failed"), error=F.lit("x")))
    records = levels.select(
        F.when(timed_out, "mysql_timeout_retry.json").otherwise(F.concat("engine", F.lit("_level1_downgrade.json"))).alias("file"),
        F.when(timed_out & (key % 7 != 0), "failed").otherwise("ok").alias("status"),
        F.when(timed_out & (key % 5 != 0), "collection timed out after 1000ms").alias("error"),
        "selected_level",
        failures.alias("attempts"),
        _named(downgrade_reasons=F.col("downgrade_reasons")).alias("payload"),
    )
    return assert_records(records, RESILIENCE_RULES).groupBy("file", "message", "passed").agg(F.count("*").alias("records"))


def source_status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_records(spark, sf_dir).select("file", F.inline(source_status(F.col("payload"))))


def merged_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_records(spark, sf_dir).select("file", F.array_join(merge_warnings(F.col("payload")), "|").alias("warnings"))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as collection cycles, turns as attempts."""
    size = F.length("text")
    ok = (F.col("role") == "assistant") & (size % 3 == 0)
    attempts = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.lit(1).alias("cycle"),
        F.col("conv_id"),
        (F.col("turn") + 1).cast("int").alias("attempt"),
        size.cast("bigint").alias("duration_ms"),
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok, F.concat(F.lit("collection timed out after "), size.cast("string"), F.lit("ms"))).alias("error"),
    )
    runs = attempts.groupBy("run_id", "cycle", "conv_id").agg(
        F.bool_or(F.col("status") == "ok").alias("_ok"), F.sum("duration_ms").alias("_spent")
    )
    engine = F.when(F.col("conv_id") % 2 == 0, "mysql").otherwise("postgres")
    level1 = F.col("conv_id") % 3 == 0
    cycles = runs.select(
        "run_id",
        "cycle",
        engine.alias("engine"),
        F.when(level1, "Level 1").otherwise("Level 0").alias("requested_level"),
        _schedule().alias("schedule"),
        F.lit(1000).cast("bigint").alias("start_unix_ms"),
        (F.col("_spent") + 500).alias("end_unix_ms"),
        F.when(F.col("_ok"), _payload(F.col("conv_id"), engine, level1)).alias("payload"),
    )
    tried = F.transform("attempts", lambda a: F.concat_ws(":", a["attempt"].cast("string"), a["duration_ms"].cast("string"), a["status"]))
    sources = F.transform("source_status", lambda s: F.concat_ws("=", s["source"], s["ok"].cast("string")))
    return assemble_records(attempts, cycles).select(
        "contract_version",
        "run_id",
        "engine",
        "requested_level",
        "selected_level",
        F.col("window.duration_ms").alias("duration_ms"),
        F.array_join(tried, "|").alias("attempts"),
        F.array_join(sources, "|").alias("source_status"),
        F.array_join("warnings", "|").alias("warnings"),
        "status",
        "error",
    )


def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as compressed JSON lines and read back, typed and as VARIANT; nulls must survive."""
    path = scratch_path(spark, "records")
    write_records(order_records(spark, sf_dir).drop("file", "file_size"), path, compression="gzip")
    landed = read_records(spark, path, multiline=False)
    null_error = F.is_variant_null(F.try_variant_get("record", "$.error", "variant"))
    flagged = landed.withColumn("null_error", null_error)
    return typed_records(flagged, keep=["null_error"]).groupBy("engine").agg(
        F.count("*").alias("records"),
        F.sum("window.duration_ms").alias("duration_ms"),
        F.count_if(F.col("payload.level1").isNotNull()).alias("level1_records"),
        F.sum(F.size("source_status")).alias("sources"),
        F.count_if("null_error").alias("null_errors"),
    )


QUERIES = {
    "assemble_records": assembled,
    "source_status": source_status_rows,
    "merge_warnings": merged_warnings,
    "validate_records": validation,
    "summarize_records": summaries,
    "diff_summaries": summary_diff,
    "diff_in_order": ordered_diff,
    "check_budgets": budgets,
    "first_budget_failure": budget_stop,
    "assert_records": assertions,
    "assert_resilience": resilience,
    "record_roundtrip": record_roundtrip,
}

_BASE = """
WITH r AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'postgres' ELSE 'mysql' END AS engine, o_orderkey % 2 = 1 AS level1,
    o_orderkey % 17 = 0 AS failed, (o_orderkey * 37) % 20000 AS duration_ms, CAST(floor(o_totalprice * 20) AS BIGINT) AS bytes,
    CASE WHEN o_orderkey % 3 = 0 THEN 'postgres_' ELSE 'mysql_' END || o_orderkey ||
    CASE WHEN o_orderkey % 2 = 1 THEN '_level1.json' ELSE '_level0.json' END AS file
  FROM orders
)"""


def _sources(where_key: str, rows: str) -> str:
    """SQL of the source status rows ``(<key>, n, source, ok)`` of relation ``rows`` (k, engine, level1)."""
    mysql = ["mysql.global_status", "mysql.variables", "mysql.information_schema", "mysql.replication_status"]
    logs = {"mysql": ["mysql.slow_log_hot_switch", "mysql.slow_log", "mysql.error_log"],
            "postgres": ["postgres.statement_log_hot_switch", "postgres.statement_log", "postgres.error_log"]}
    postgres = ["postgres.global_status", "postgres.settings", "postgres.storage", "postgres.replication_status"]
    parts = [f"SELECT {where_key}, 0 AS n, 'os.basic_metrics' AS source, (k + 5) % 7 <> 0 AS ok FROM {rows}"]
    parts += [f"SELECT {where_key}, {i}, '{name}', (k + {i}) % 7 <> 0 FROM {rows} WHERE engine = 'mysql'" for i, name in enumerate(mysql, 1)]
    for engine, names in logs.items():
        parts += [
            f"SELECT {where_key}, {i + 4}, '{name}', (k + {i}) % 3 <> 0 FROM {rows} WHERE level1 AND engine = '{engine}'" for i, name in enumerate(names, 1)
        ]
    parts += [f"SELECT {where_key}, {i + 7}, '{name}', (k + {i}) % 5 <> 0 FROM {rows} WHERE engine = 'postgres'" for i, name in enumerate(postgres, 1)]
    return " UNION ALL ".join(parts)


_OK_ROWS = _BASE + ", g AS (SELECT * FROM r WHERE NOT failed), s AS (" + _sources("file", "g") + ")"
_STATUS = "CASE WHEN failed THEN 'failed' ELSE 'ok' END"
_LEVEL = "CASE WHEN level1 THEN 'Level 1' ELSE 'Level 0' END"
_CATEGORY_SQL = "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'deadlock|purge' WHEN 2 THEN 'replication' ELSE 'crash_recovery|deadlock' END"

_BUDGET = _BASE + """, b AS (SELECT *, CASE WHEN level1 THEN 15000 ELSE 5000 END AS allowed FROM r),
f AS (
  SELECT *, CASE WHEN failed THEN 'status=failed' WHEN duration_ms > allowed THEN 'duration_ms=' || duration_ms || ' > ' || allowed
    WHEN bytes > 8000000 THEN 'bytes=' || bytes || ' > 8000000' END AS failure FROM b
)"""


def _assertion(where: str, message: str, passed: str) -> str:
    return f"SELECT file, '{message}' AS message, {passed} AS passed FROM r WHERE {where}"


def _assertions() -> str:
    parts = []
    for engine in ("mysql", "postgres"):
        level0, level1 = f"engine = '{engine}' AND NOT level1", f"engine = '{engine}' AND level1"
        parts.append(_assertion(level0, f"{engine} level0 record status", "NOT failed"))
        parts.append(_assertion(level0, f"{engine} level0 selected level 0", "NOT failed"))
        parts.append(_assertion(level1, f"{engine} level1 record status", "NOT failed"))
        parts.append(_assertion(level1, f"{engine} level1 selected level 1", "NOT failed"))
        parts.append(_assertion(level1, f"{engine} level1 level1 payload present", "NOT failed"))
        parts.append(_assertion(level1, f"{engine} level1 hot-switch capability", "NOT failed AND (k + 1) % 3 <> 0"))
        parts.append(_assertion(level1, f"{engine} level1 slow log readable", "NOT failed AND (k + 2) % 3 <> 0"))
        parts.append(_assertion(level1, f"{engine} level1 error log readable", "NOT failed AND k % 3 <> 0"))
        parts.append(_assertion(level1, f"{engine} level1 slow log digest generated", "NOT failed AND k % 3 >= 1"))
        parts.append(_assertion(level1, f"{engine} level1 deadlock alert detected", "NOT failed AND k % 4 IN (1, 3)"))
    for number, name in enumerate(["status", "variables", "information_schema"], 1):
        parts.append(_assertion("engine = 'mysql' AND NOT level1", f"mysql level0 {name} access", f"NOT failed AND (k + {number}) % 7 <> 0"))
    for number, name in enumerate(["status", "settings", "storage"], 1):
        parts.append(_assertion("engine = 'postgres' AND NOT level1", f"postgres level0 {name} access", f"NOT failed AND (k + {number}) % 5 <> 0"))
    return " UNION ALL ".join(parts)


ORACLES = {
    "assemble_records": """
WITH a AS (
  SELECT conv_id, turn + 1 AS attempt, length(text) AS size, role = 'assistant' AND length(text) % 3 = 0 AS ok FROM conversations
), f AS (SELECT *, min(attempt) FILTER (WHERE ok) OVER (PARTITION BY conv_id) AS first_ok FROM a),
t AS (
  SELECT conv_id AS k, sum(size) - 500 AS spent, bool_or(ok) AS good,
    string_agg(attempt || ':' || size || ':' || CASE WHEN ok THEN 'ok' ELSE 'failed' END, '|' ORDER BY attempt) FILTER (WHERE first_ok IS NULL OR attempt <= first_ok) AS attempts,
    arg_max('collection timed out after ' || size || 'ms', attempt) FILTER (WHERE NOT ok AND (first_ok IS NULL OR attempt <= first_ok)) AS error
  FROM f GROUP BY 1
), r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS engine, k % 3 = 0 AS level1 FROM t),
g AS (SELECT * FROM r WHERE good), s AS (""" + _sources("k", "g") + """),
j AS (SELECT k, string_agg(source || '=' || ok, '|' ORDER BY n) AS sources FROM s GROUP BY 1)
SELECT 'v1' AS contract_version, 'run-' || k AS run_id, engine, CASE WHEN level1 THEN 'Level 1' ELSE 'Level 0' END AS requested_level,
  CASE WHEN good THEN CASE WHEN level1 THEN 'Level 1' ELSE 'Level 0' END END AS selected_level,
  CAST(greatest(spent, 0) AS BIGINT) AS duration_ms, attempts, coalesce(sources, '') AS source_status,
  CASE WHEN NOT good THEN '' ELSE concat_ws('|', CASE WHEN k % 2 = 0 THEN 'level0 ' || k END, CASE WHEN level1 THEN 'level1 a|level1 b' END,
    CASE WHEN engine = 'postgres' THEN 'postgres level0' END) END AS warnings,
  CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, error
FROM r LEFT JOIN j USING (k)""",
    "source_status": _OK_ROWS + " SELECT file, source, ok FROM s",
    "merge_warnings": _BASE + """
SELECT file, CASE WHEN failed THEN '' ELSE concat_ws('|', CASE WHEN k % 2 = 0 THEN 'level0 ' || k END, CASE WHEN level1 THEN 'level1 a|level1 b' END,
  CASE WHEN engine = 'postgres' THEN 'postgres level0' END) END AS warnings FROM r""",
    "validate_records": _BASE + """
SELECT file, path, rule, found FROM r JOIN (VALUES
  (0, 'cycle', 'minimum 1', '0'), (1, 'contract_version', 'const v1', 'v2'), (2, 'run_id', 'required', 'missing'),
  (3, 'schedule.jitter_pct', 'type number', 'string'), (4, 'attempts[0].attempt', 'type integer', 'number'),
  (5, 'payload.level0.os.proc_cpu', 'type object', 'null'), (6, '', 'json', 'unreadable'), (7, 'schedule.mode', 'type string', 'integer'),
  (8, 'warnings[1]', 'type string', 'integer'), (9, 'payload', 'type object|null', 'array'), (10, 'window.start_unix_ms', 'minimum 0', '-1')
) d(kind, path, rule, found) ON k % 20 = kind WHERE kind <> 5 OR NOT failed""",
    "summarize_records": _OK_ROWS + f""",
j AS (SELECT file, string_agg(source || '=' || ok, '|' ORDER BY source) AS sources FROM s GROUP BY 1)
SELECT file, 'v1' AS contract_version, engine, {_LEVEL} AS requested_level, CASE WHEN NOT failed THEN {_LEVEL} END AS selected_level, {_STATUS} AS status,
  coalesce(sources, '') AS source_status, level1 AND NOT failed AS enabled, level1 AND NOT failed AND (k + 1) % 3 <> 0 AS hot_switch_ok,
  level1 AND NOT failed AND (k + 2) % 3 <> 0 AS slow_log_ok, level1 AND NOT failed AND k % 3 <> 0 AS error_log_ok,
  level1 AND NOT failed AND k % 3 >= 1 AS digest_count_ge_1, CASE WHEN level1 AND NOT failed THEN {_CATEGORY_SQL} ELSE '' END AS alert_categories
FROM r LEFT JOIN j USING (file)""",
    "diff_summaries": _BASE + f"""
SELECT 'unexpected' AS difference, file, {_STATUS} AS status FROM r WHERE k % 60 = 7 OR k % 50 = 0
UNION ALL SELECT 'missing', file, 'late' FROM r WHERE k % 60 <> 7 AND k % 50 = 0""",
    "diff_in_order": _BASE + f""", a AS (
  SELECT row_number() OVER (ORDER BY file) - 1 AS p, file, {_STATUS} AS status FROM r
), e AS (
  SELECT p + CASE p % 100 WHEN 3 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS p, file, status FROM a
)
SELECT a.p AS position, 'unexpected' AS difference, a.file, a.status FROM a LEFT JOIN e USING (p) WHERE e.file IS DISTINCT FROM a.file
UNION ALL SELECT e.p, 'missing', e.file, e.status FROM e LEFT JOIN a USING (p) WHERE e.file IS DISTINCT FROM a.file""",
    "check_budgets": _BUDGET + " SELECT file, duration_ms, bytes, failure IS NULL AS passed, failure FROM f",
    "first_budget_failure": _BUDGET + " SELECT file, failure FROM f WHERE failure IS NOT NULL ORDER BY file LIMIT 1",
    "assert_records": _BASE + " " + _assertions(),
    "assert_resilience": """
WITH r AS (SELECT o_orderkey AS k FROM orders), d AS (
  SELECT k, CASE k % 3 WHEN 1 THEN 'mysql' ELSE 'postgres' END AS engine,
    k % 5 <> 0 AS no_switch, (k + 1) % 5 <> 0 AS no_slow, (k + 2) % 5 <> 0 AS no_error FROM r WHERE k % 3 <> 0
), a AS (
  SELECT 'mysql_timeout_retry.json' AS file, unnest([
    {'message': 'mysql timeout status failed', 'passed': k % 7 <> 0}, {'message': 'mysql timeout retried 3 attempts', 'passed': k % 4 <> 0},
    {'message': 'mysql timeout all attempts failed', 'passed': true}, {'message': 'mysql timeout error surfaced', 'passed': k % 5 <> 0}]) AS c
  FROM r WHERE k % 3 = 0
  UNION ALL
  SELECT engine || '_level1_downgrade.json', unnest([
    {'message': engine || ' downgrade record status', 'passed': true}, {'message': engine || ' downgrade downgraded to level 0', 'passed': true},
    {'message': engine || ' downgrade reason hot switch', 'passed': no_switch},
    {'message': engine || ' downgrade reason ' || CASE engine WHEN 'mysql' THEN 'slow log' ELSE 'statement log' END, 'passed': no_slow},
    {'message': engine || ' downgrade reason error log', 'passed': no_error}]) FROM d
)
SELECT file, c.message AS message, c.passed AS passed, count(*) AS records FROM a GROUP BY ALL""",
    "record_roundtrip": _OK_ROWS + """
SELECT engine, count(*) AS records, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (WHERE level1 AND NOT failed) AS level1_records,
  (SELECT count(*) FROM s JOIN r q USING (file) WHERE q.engine = r.engine) AS sources, count(*) FILTER (WHERE NOT failed) AS null_errors
FROM r GROUP BY engine""",
}
