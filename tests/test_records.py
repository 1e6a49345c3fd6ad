"""Collection records: contract, files, summaries, assertions."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows

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
from dbgauge.operators.contract import validate_records
from dbgauge.operators.envelope import fold_attempts
from dbgauge.plans import record_queries
from dbgauge.sources import records as record_files
from dbgauge.sources.records import read_ordered_summaries, read_records, read_summaries, typed_records, write_records


#: When the cycle of the records of these tests began.
STARTED = 1_712_908_800_000


def command(name):
    return {"command": name, "args": [], "available": False, "status_code": None, "output": None, "error": None}


def record(engine="mysql", level1=False):
    level = "Level 1" if level1 else "Level 0"
    mysql = engine == "mysql"
    flags = ["mysql_status_access", "mysql_variables_access", "information_schema_access", "replication_status_access"]
    logs = {
        "collected_at_unix_ms": STARTED + 640,
        "capability": {"mysql_connected": mysql, "postgres_connected": not mysql, "can_enable_slow_log_hot_switch": True,
                       "can_read_slow_log": True, "can_read_error_log": True},
        "slow_log": {"enabled_for_window": True, "window_secs": 42, "long_query_time_secs": 0.75, "slow_log_path": "/srv/db7/slow.txt", "previous_slow_query_log": "OFF",
                     "previous_long_query_time": "1.5", "collected_bytes": 7321, "parsed_entries": 19, "digest_count": 4, "digests": [{}] * 4},
        "error_log": {"error_log_path": None, "sampled_lines": 88, "alert_count": 6, "alerts": [{"category": "purge"}, {"category": "deadlock"}, {"category": "purge"}]},
        "warnings": [],
    }
    postgres = {"collected_at_unix_ms": STARTED + 310, "capability": {name: True for name in ("postgres_connected", "has_status_access", "has_settings_access",
                "has_storage_access", "has_replication_status_access")}, "postgres": {}, "warnings": []}
    return {
        "contract_version": "v1", "run_id": "shard-c/0412", "cycle": 9, "engine": engine, "requested_level": level, "selected_level": level,
        "schedule": {"mode": "daemon", "interval_secs": 900, "jitter_pct": 0.35, "timeout_secs": 48, "retry_times": 4, "retry_backoff_ms": 275, "max_cycles": None},
        "window": {"start_unix_ms": STARTED, "end_unix_ms": STARTED + 1130, "duration_ms": 1130},
        "attempts": [{"attempt": 1, "duration_ms": 410, "status": "failed", "error": "host busy"}, {"attempt": 2, "duration_ms": 445, "status": "ok", "error": None}],
        "source_status": [{"source": "os.basic_metrics", "ok": True}, {"source": "mysql.variables", "ok": True}],
        "warnings": [], "status": "ok", "error": None,
        "payload": {
            "engine": engine, "requested_level": level, "selected_level": level, "downgrade_reasons": [],
            "level0": {
                "collected_at_unix_ms": STARTED + 120,
                "capability": {"mysql_connected": mysql, "os_metrics_access": True, **dict.fromkeys(flags, mysql)},
                "mysql": {"global_status": {}, "global_variables": {}, "table_sizes": [], "indexes": [], "replication_status": None, "replication_status_source": None},
                "os": {"proc_cpu": {}, "proc_mem": {}, "load_average": {}, **{name: command(name) for name in ("vmstat", "iostat", "sar")}},
                "warnings": [],
            },
            "postgres_level0": None if mysql else postgres,
            "level1": logs if level1 else None,
        },
    }


def changed(path, value=..., base=None):
    """A record with one place changed, or removed where no value is given."""
    out = copy.deepcopy(base or record("postgres", True))
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


CASES = [
    (record(), []),
    (record("postgres", True), []),
    (changed(["payload"], None), []),
    (changed(["cycle"], 2.0), []),
    (changed(["extra"], {"any": [1]}), []),
    (changed(["cycle"], 0), [("cycle", "minimum 1", "0")]),
    (changed(["cycle"], 1.5), [("cycle", "type integer", "number")]),
    (changed(["contract_version"], "v2"), [("contract_version", "const v1", "v2")]),
    (changed(["selected_level"]), [("selected_level", "required", "missing")]),
    (changed(["error"], 5), [("error", "type string|null", "integer")]),
    (changed(["schedule"], []), [("schedule", "type object", "array")]),
    (changed(["schedule"], {}), [(f"schedule.{n}", "required", "missing") for n in
                                 ("interval_secs", "jitter_pct", "max_cycles", "mode", "retry_backoff_ms", "retry_times", "timeout_secs")]),
    (changed(["schedule", "max_cycles"], 0), [("schedule.max_cycles", "minimum 1", "0")]),
    (changed(["attempts"], ["x", {"attempt": 0, "duration_ms": -1, "status": "ok"}]),
     [("attempts[0]", "type object", "string"), ("attempts[1].attempt", "minimum 1", "0"), ("attempts[1].duration_ms", "minimum 0", "-1"),
      ("attempts[1].error", "required", "missing")]),
    (changed(["source_status", 1, "ok"], "yes"), [("source_status[1].ok", "type boolean", "string")]),
    (changed(["warnings"], ["a", None]), [("warnings[1]", "type string", "null")]),
    (changed(["payload", "level0", "os", "proc_mem"], None), [("payload.level0.os.proc_mem", "type object", "null")]),
    (changed(["payload", "level0", "os", "sar", "args"], [1]), [("payload.level0.os.sar.args[0]", "type string", "integer")]),
    (changed(["payload", "level0", "mysql", "indexes"], [[]]), [("payload.level0.mysql.indexes[0]", "type object", "array")]),
    (changed(["payload", "postgres_level0", "capability", "has_storage_access"]), [("payload.postgres_level0.capability.has_storage_access", "required", "missing")]),
    (changed(["payload", "level1", "slow_log", "long_query_time_secs"], -0.5), [("payload.level1.slow_log.long_query_time_secs", "minimum 0", "-0.5")]),
    (changed(["payload", "level1"], False), [("payload.level1", "type object|null", "boolean")]),
    ([1], [("", "type object", "array")]),
]


def test_contract(spark):
    texts = [(f"{n:02d}", json.dumps(case)) for n, (case, _) in enumerate(CASES)] + [("bad", "{"), ("null", "null")]
    frame = spark.createDataFrame(texts, "file string, text string").withColumn("record", F.try_parse_json("text"))
    found = {}
    for row in validate_records(frame).collect():
        found.setdefault(row.file, []).append((row.path, row.rule, row.found))
    want = {f"{n:02d}": sorted(broken) for n, (_, broken) in enumerate(CASES) if broken}
    want |= {"bad": [("", "json", "unreadable")], "null": [("", "type object", "null")]}
    assert {key: sorted(value) for key, value in found.items()} == want
    plan = validate_records(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("pretty", [False, True])
def test_files_keep_nulls(spark, write, tmp_path, pretty):
    path = write(a__json=json.dumps(record(), indent=2 if pretty else None), b__json=json.dumps(record("postgres", True)), c__json="{broken")
    landed = read_records(spark, path)
    assert sorted(r.file for r in landed.collect()) == ["a.json", "b.json", "c.json"]
    assert [r.file for r in validate_records(landed).collect()] == ["c.json"]
    out = str(tmp_path / "out")
    write_records(typed_records(landed).filter(F.col("file") != "c.json").drop("file", "file_size").coalesce(2), out, pretty)
    again = read_records(spark, out, multiline=False) if not pretty else None
    if again is not None:
        assert validate_records(again).count() == 0
        assert {r.engine for r in typed_records(again).collect()} == {"mysql", "postgres"}
    else:
        text = spark.read.text(out, wholetext=True).first().value
        assert '\n  "selected_level"' in text and '"max_cycles" : null' in text


def landed(spark, **records):
    data = [(name.replace("__", "."), 100, json.dumps(value)) for name, value in records.items()]
    return typed_records(spark.createDataFrame(data, "file string, file_size bigint, text string"))


def test_summary_and_diff(spark):
    frame = summarize_records(landed(spark, a__json=record(), b__json=record("postgres", True)))
    a, b = rows(frame.orderBy("file"))
    assert a["source_status"] == [{"source": "mysql.variables", "ok": True}, {"source": "os.basic_metrics", "ok": True}]
    assert a["level1"] == {"enabled": False, "hot_switch_ok": False, "slow_log_ok": False, "error_log_ok": False, "digest_count_ge_1": False, "alert_categories": []}
    assert b["level1"]["alert_categories"] == ["deadlock", "purge"] and b["level1"]["digest_count_ge_1"] is True
    assert diff_summaries(frame, frame).count() == 0
    twice = frame.unionByName(frame.filter("file = 'a.json'"))
    assert [(r.difference, r.file) for r in diff_summaries(twice, frame).collect()] == [("unexpected", "a.json")]
    assert [(r.difference, r.file) for r in diff_summaries(frame, twice).collect()] == [("missing", "a.json")]


def test_order_of_summaries_counts(spark, tmp_path):
    """Rows over many tasks are numbered without gaps; the same rows in another order differ, and so does a longer list."""
    rows = numbered(spark.range(1000, numPartitions=7).selectExpr("(id * 387) % 1000 as v", "cast(null as string) as w"), "v")
    assert {r.v: r.position for r in rows.collect()} == {v: v for v in range(1000)}
    swapped = rows.selectExpr("case position when 10 then 700 when 700 then 10 else position end as position", "v", "w")
    assert diff_in_order(rows, rows).count() == 0
    got = sorted((r.position, r.difference, r.v) for r in diff_in_order(rows, swapped).collect())
    assert got == [(10, "missing", 700), (10, "unexpected", 10), (700, "missing", 10), (700, "unexpected", 700)]
    assert [tuple(r) for r in diff_in_order(rows, rows.where("position < 999")).collect()] == [(999, "unexpected", 999, None)]
    assert diff_in_order(rows.limit(0), numbered(rows.limit(0).drop("position"), "v")).count() == 0
    golden = tmp_path / "golden.json"
    golden.write_text('[{"file": "b"}, {"file": "a", "status": "ok"}]')
    assert [(r.position, r.file, r.status) for r in read_ordered_summaries(spark, str(golden)).orderBy("position").collect()] == [(0, "b", None), (1, "a", "ok")]


def test_budgets(spark):
    slow = changed(["window", "duration_ms"], 6000, record())
    frame = landed(spark, a__json=record(), b_level1__json=slow, c__json=slow, d__json=changed(["status"], "failed", slow), e__json=changed(["window"], base=record()))
    got = {r.file: r.failure for r in check_budgets(frame).collect()}
    assert got == {"a.json": None, "b_level1.json": None, "c.json": "duration_ms=6000 > 5000", "d.json": "status=failed", "e.json": None}
    assert first_failure(check_budgets(frame)).first().file == "c.json"


def test_assertions(spark):
    failed = changed(["attempts"], [{"attempt": n, "duration_ms": 1000, "status": "failed", "error": "collection timed out after 1000ms"} for n in (1, 2, 3)], record())
    failed.update(status="failed", error="collection timed out after 1000ms", payload=None, selected_level=None)
    down = changed(["payload", "downgrade_reasons"], ["[Level 1] cannot hot-enable slow log; cannot collect error log"], record())
    frame = landed(spark, mysql_8_0_level0__json=record(), postgres_16_level1__json=record("postgres", True), mysql_timeout_retry__json=failed,
                   mysql_level1_downgrade__json=down, other__json=record())
    matrix = assert_records(frame, MATRIX_RULES)
    assert matrix.filter("NOT passed").count() == 0 and matrix.count() == 5 + 8
    resilience = assert_records(frame, RESILIENCE_RULES)
    assert [r.message for r in resilience.filter("NOT passed").collect()] == ["mysql downgrade reason slow log"]
    assert resilience.count() == 4 + 5


def test_attempts_stop_at_first_ok(spark):
    data = [("r", 1, 2, 5, "ok", None), ("r", 1, 1, 9, "failed", "timeout"), ("r", 1, 3, 1, "failed", "late"), ("s", 1, 1, 1, "failed", "x"), ("s", 1, 2, 1, "failed", "y")]
    frame = spark.createDataFrame(data, "run_id string, cycle int, attempt int, duration_ms bigint, status string, error string")
    r, s = rows(fold_attempts(frame).orderBy("run_id"))
    assert [a["status"] for a in r["attempts"]] == ["failed", "ok"] and r["error"] == "timeout"
    assert len(s["attempts"]) == 2 and s["error"] == "y"


def test_golden_summaries(spark, write, tmp_path):
    """Record files against a golden array, as a release gate compares them."""

    def summary(file, level1):
        level = "Level 1" if level1 else "Level 0"
        return {
            "file": file, "contract_version": "v1", "engine": "mysql", "requested_level": level, "selected_level": level, "status": "ok",
            "source_status": [{"source": "mysql.variables", "ok": True}, {"source": "os.basic_metrics", "ok": True}],
            "level1": {"enabled": level1, "hot_switch_ok": level1, "slow_log_ok": level1, "error_log_ok": level1, "digest_count_ge_1": level1,
                       "alert_categories": ["deadlock", "purge"] if level1 else []},
        }

    path = write(mysql_a_level0__json=json.dumps(record()), mysql_b_level1__json=json.dumps(record("mysql", True)))
    golden = tmp_path / "golden.json"
    actual = summarize_records(typed_records(read_records(spark, path)))
    golden.write_text(json.dumps([summary("mysql_a_level0.json", False), summary("mysql_b_level1.json", True)], indent=2))
    assert diff_summaries(actual, read_summaries(spark, str(golden))).count() == 0
    golden = tmp_path / "other.json"
    golden.write_text(json.dumps([summary("mysql_a_level0.json", False), summary("mysql_c_level1.json", True)], indent=2))
    found = diff_summaries(actual, read_summaries(spark, str(golden))).collect()
    assert sorted((r.difference, r.file) for r in found) == [("missing", "mysql_c_level1.json"), ("unexpected", "mysql_b_level1.json")]


def test_files_that_are_not_one_record(spark, write):
    """Empty files and text behind a value are seen, not skipped or cut."""
    path = write(a__json='{"x": 1}', b__json="", c__json=" \n", d__json='{"x": 1} junk', e__json='{"x": 1}\n{"x": 2}', f__json='{"x": 1},"end"', g__json='{"x": 1}, null', h__json=' {"x": [1, 2]}\n', i__json='{"x": 1}]')
    landed = read_records(spark, path)
    assert {r.file: r.ok for r in landed.selectExpr("file", "record is not null as ok").collect()} == {f"{n}.json": n in "ah" for n in "abcdefghi"}
    broken = {r.file for r in validate_records(landed).collect()}
    assert {f"{n}.json" for n in "bcdefgi"} <= broken
    assert {r.file for r in typed_records(landed).where("engine is null").collect()} == {f"{n}.json" for n in "abcdefghi"}


def test_pretty_records_stand_in_files_of_their_own(spark, tmp_path):
    out = str(tmp_path / "pretty")
    write_records(spark.range(5).coalesce(1), out, pretty=True)
    assert sorted(r.id for r in read_records(spark, out).selectExpr("try_variant_get(record, '$.id', 'int') as id").collect()) == [0, 1, 2, 3, 4]


def test_roundtrip_keeps_records_compressed(spark, tmp_path, monkeypatch):
    """Records on disk are a small part of their text, whatever their number; rows without a key or that repeat are kept."""
    orders = [(key, 1.5) for key in [*range(400), 7, 7, None]]
    spark.createDataFrame(orders, "o_orderkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    kept = tmp_path / "kept"
    monkeypatch.setattr(record_queries, "scratch_path", lambda *_: str(kept))
    found = record_queries.record_roundtrip(spark, str(tmp_path)).collect()
    text = sum(len(r.value) for r in spark.read.text(str(kept)).collect())
    assert sum(r.records for r in found) == len(orders) and text > 2000 * len(orders)
    assert sum(file.stat().st_size for file in kept.iterdir()) * 4 < text


def test_compressed_files_are_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record_files, "COMPRESSED_RECORDS", 30)
    out = tmp_path / "out"
    write_records(spark.range(100).selectExpr("id", "cast(null as string) as error").coalesce(1), str(out), compression="gzip")
    assert len(list(out.glob("part-*.gz"))) == 4
    again = read_records(spark, str(out), multiline=False)
    assert sorted(r.id for r in again.selectExpr("try_variant_get(record, '$.id', 'int') as id").collect()) == [*range(100)]
    assert again.selectExpr("count_if(is_variant_null(try_variant_get(record, '$.error', 'variant'))) as n").first().n == 100
