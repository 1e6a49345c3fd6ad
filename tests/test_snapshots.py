"""Catalog, status, host, capability operators on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows

from dbgauge.functions import is_truthy, parse_double, strip_ws, text_or_empty, unsigned_or_zero
from dbgauge.functions.values import as_text
from dbgauge.operators.capability import Policy, PROBE_FLAGS, capabilities, downgrade_reasons, negotiate, plan_tasks
from dbgauge.operators.catalog import table_sizes_mysql, table_sizes_pg
from dbgauge.operators.hostmetrics import command_samples, parse_os_samples
from dbgauge.operators.segments import appended_since, tail_lines
from dbgauge.operators.snapshots import slow_log_snapshot
from dbgauge.operators.status import PG_COUNTERS, pairs_to_map, pg_replication_status, pg_status_rollup, replication_status
from dbgauge.sources.files import latest_files, list_files, resolve_log_paths
from dbgauge.sources.logs import lines_from_table, read_log_lines


def test_os_samples(spark):
    contents = [
        ("a", 1, "/proc/stat", "cpu  71 5 2301 88000 640 9 31 2 0 0\ncpu0 3 1 4 1 5 9 2 6 5 3"),
        ("a", 1, "/proc/meminfo", "MemTotal:       16336512 kB\nMemAvailable:    912004 kB\nSwapTotal:      2097148 kB\nSwapFree:       2096000 kB\n"),
        ("a", 1, "/proc/loadavg", "1.25 0.75 0.05 3/1417 20771"),
        ("b", 1, "/proc/stat", "cpu 1 2 3 x"),
        ("b", 1, "/proc/meminfo", "MemTotal: 5\nMemTotal: 6 kB\nMemTotal: 7x kB\n MemAvailable : +4\r\n"),
        ("b", 1, "/proc/loadavg", "0.1 0.2 0.3 2/222"),
        ("c", 1, "/proc/stat", "cpu 1 2 3 4 bad 6"),
        ("c", 1, "/proc/meminfo", "MemTotal: 5\n"),
        ("d", 1, "/proc/other", "x"),
    ]
    samples = spark.createDataFrame(contents, "instance string, ts int, path string, content string")
    a, b, c = rows(parse_os_samples(samples).orderBy("instance"))
    assert a["proc_cpu"] == {"user": 71, "nice": 5, "system": 2301, "idle": 88000, "iowait": 640, "irq": 9, "softirq": 31, "steal": 2}
    assert a["proc_mem"] == {"mem_total_kb": 16336512, "mem_available_kb": 912004, "swap_total_kb": 2097148, "swap_free_kb": 2096000}
    assert a["load_average"] == {"one": 1.25, "five": 0.75, "fifteen": 0.05, "running_tasks": "3/1417", "last_pid": 20771}
    assert b["proc_cpu"] is None and b["load_average"] is None
    assert b["proc_mem"] == {"mem_total_kb": 6, "mem_available_kb": 4, "swap_total_kb": 0, "swap_free_kb": 0}
    assert c["proc_cpu"]["iowait"] == 0 and c["proc_cpu"]["irq"] == 6 and c["proc_mem"] is None


def test_command_samples(spark):
    raw = [
        ("vmstat", True, 0, " x" + "y" * 3999 + " \n", ""),
        ("iostat", True, 1, "z" * 4001, "  "),
        ("sar", False, None, None, None),
        ("top", True, 2, "", " denied "),
        ("who", True, None, None, "permission denied"),
    ]
    frame = spark.createDataFrame(raw, "command string, found boolean, status_code int, stdout string, stderr string")
    got = {r["command"]: r for r in rows(command_samples(frame))}
    assert got["vmstat"]["output"] == "x" + "y" * 3999 and got["vmstat"]["error"] is None and got["vmstat"]["warning"] is None
    assert got["iostat"]["output"] == "z" * 4000 + "\n...[truncated]"
    assert got["iostat"]["error"] == "exit status: exit status: 1"
    assert got["sar"]["available"] is False and got["sar"]["error"] == "command not found" and got["sar"]["warning"] is None
    assert got["top"]["output"] is None and got["top"]["warning"] == "top failed: denied"
    assert got["who"]["available"] is True and got["who"]["error"] == "permission denied"


def test_values_as_text(spark):
    frame = spark.sql(
        "SELECT 1e7D AS a, 1.0E-5D AS b, -0.0D AS c, 123456789012345680000D AS d, double('nan') AS e, -1.5D AS f, "
        "timestamp_ntz'2026-01-02 03:04:05.000006' AS g, interval '-1 02:03:04.5' day to second AS h, "
        "cast(null as int) AS i, X'ff41' AS j, double('-inf') AS k, interval '34' hour AS l, 100D AS m"
    )
    got = frame.select(*[as_text(F.col(f.name), f.dataType).alias(f.name) for f in frame.schema.fields]).first()
    assert tuple(got) == (
        "10000000", "0.00001", "-0", "123456789012345680000", "NaN", "-1.5", "2026-01-02 03:04:05.000006",
        "-1 02:03:04.500000", "NULL", "�A", "-inf", "1 10:00:00.000000", "100",
    )


def test_pairs_last_wins(spark):
    pairs = spark.createDataFrame([("a", 1, "x", "1"), ("a", 2, "x", "2"), ("a", 1, "b", None)], "instance string, pos bigint, name string, value string")
    assert pairs_to_map(pairs).first()["pairs"] == {"b": None, "x": "2"}


def test_status_rollup_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], ", ".join(f"{name} bigint" for name in PG_COUNTERS))
    assert {r.metric: r.value for r in pg_status_rollup(empty).collect()} == dict.fromkeys(PG_COUNTERS, "0")


def test_pg_replication_single_instance(spark):
    recovery = spark.createDataFrame([(True,)], "in_recovery boolean")
    clients = spark.createDataFrame([], "pid int")
    receivers = spark.createDataFrame([("streaming",)], "status string")
    got = {r.metric: r.value for r in pg_replication_status(recovery, clients, receivers, by=[]).collect()}
    assert got == {"is_in_recovery": "true", "replication_clients": "0", "wal_receiver_status": "streaming"}


def test_replication_fallback(spark):
    data = [("a", "REPLICA", True, None, 1), ("a", "SLAVE", True, "s", 2), ("b", "REPLICA", False, None, 1), ("b", "SLAVE", True, "s", 2), ("c", "REPLICA", False, None, 1)]
    frame = spark.createDataFrame(data, "instance string, source string, ok boolean, payload string, priority int")
    got = [tuple(r) for r in replication_status(frame).orderBy("instance").collect()]
    assert got == [("a", True, "REPLICA", None), ("b", True, "SLAVE", "s"), ("c", False, None, None)]


def test_table_sizes_keep_negative_estimates_and_bad_numbers(spark):
    classes = spark.createDataFrame([(1, "t", "r", -1.0, 1, None, 9), (1, "i", "i", 1.0, 1, 1, 99), (2, "c", "r", 1.0, 1, 1, 999)],
                                    "relnamespace int, relname string, relkind string, reltuples double, data_length bigint, index_length bigint, total_length bigint")
    spaces = spark.createDataFrame([(1, "public"), (2, "pg_catalog")], "oid int, nspname string")
    assert [tuple(r) for r in table_sizes_pg(classes, spaces).collect()] == [("public", "t", -1, 1, 0, 9, 1)]
    tables = spark.createDataFrame([("app", "a", None, "NULL", "5", "x"), ("sys", "b", "E", "1", "9", "9")],
                                   "table_schema string, table_name string, engine string, table_rows string, data_length string, index_length string")
    assert [tuple(r) for r in table_sizes_mysql(tables).collect()] == [("app", "a", "", 0, 5, 0, 5, 1)]


def probe(spark, **flags):
    values = {flag: True for flag in PROBE_FLAGS} | flags
    schema = "instance string, engine string, " + ", ".join(f"{flag} boolean" for flag in PROBE_FLAGS)
    return spark.createDataFrame([("a", "postgres", *[values[flag] for flag in PROBE_FLAGS])], schema)


def test_negotiation(spark):
    blind = dict.fromkeys(PROBE_FLAGS[8:], False)
    capped = negotiate(probe(spark), Policy())
    assert capped.first()["selected_level"] == "Level 2"
    lower = negotiate(probe(spark, **blind), Policy(3, 3, True))
    assert lower.first()["selected_level"] == "Level 1"
    assert [e["level_no"] for e in lower.first()["evaluations"]] == [3, 2, 1, 0]
    assert plan_tasks(lower).count() == 8 and plan_tasks(capped).count() == 13
    nothing = downgrade_reasons(negotiate(probe(spark, has_mysql_status_access=False, can_read_error_log=False), Policy(1, 1)))
    assert nothing.first()["selected_level"] == "Level 0"
    assert nothing.first()["downgrade_reasons"] == [
        "[Level 1] missing pg_stat_database access; cannot collect PostgreSQL log alerts",
        "[Level 0] missing pg_stat_database access",
    ]
    assert "Join" not in plan_tasks(capped)._jdf.queryExecution().executedPlan().toString()


def test_capabilities_need_all_or_any(spark):
    data = [("a", "mysql.tables", True), ("a", "os.sar", True), ("a", "os.iostat", False), ("a", "mysql.replication_status", False),
            ("a", "mysql.replication_status", True), ("b", "mysql.tables", True), ("b", "mysql.indexes", True)]
    a, b = capabilities(spark.createDataFrame(data, "instance string, source string, ok boolean")).orderBy("instance").collect()
    assert a.information_schema_access is False and a.os_metrics_access is True and a.replication_status_access is True
    assert b.information_schema_access is True and b.os_metrics_access is False


def test_latest_file_tie(spark, tmp_path):
    for name in ("a.log", "b.log", "old.log"):
        (tmp_path / name).write_text("x")
    files = list_files(spark, str(tmp_path))
    when = datetime.datetime(2026, 1, 1)
    tied = files.withColumn("modification_time", F.when(F.col("path").endswith("old.log"), F.lit(when)).otherwise(F.lit(when + datetime.timedelta(1))))
    assert latest_files(tied).first()["path"].endswith("/b.log")


def offsets(text):
    out, at = [], 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        out.append((at, line))
        at += len(line.encode()) + 1
    return out


@pytest.mark.parametrize("known,cap", [(None, 10**9), (30, 10**9), (30, 25), (10**6, 40), (0, 1), (33, 10**9), (35, 10**9), (36, 10**9)])
def test_appended_since(spark, write, known, cap):
    text = "".join(f"line é {i}\n" if i % 4 else "\n" for i in range(40))
    path = write(x__log=text)
    lines = read_log_lines(spark, path)
    source = lines.first()["source"]
    marks = spark.createDataFrame([(source, known)], "source string, offset bigint")
    size, offset = len(text.encode()), known or 0
    start = max(size - cap, 0) if size < offset or size - offset > cap else offset
    got = [(r.offset, r.line) for r in appended_since(lines, marks, cap).orderBy("offset").collect()]
    want = []
    for at, line in offsets(text):
        if at + len(line.encode()) + 1 > start:
            cut = max(start - at, 0)
            want.append((at + cut, line.encode()[cut:].decode(errors="replace")))
    assert got == want


@pytest.mark.parametrize("max_lines,max_bytes", [(3, None), (500, None), (3, 60), (50, 60), (4, 10**6)])
def test_tail_blockwise(spark, max_lines, max_bytes):
    texts = {f"s{k}": "".join(("x" * (i % 7) + ("\n" if i % 3 else " \n")) for i in range(100 * k)) for k in (1, 2)}
    data = [(s, i, line) for s, text in texts.items() for i, (_, line) in enumerate(offsets(text))]
    frame = spark.createDataFrame(data, "s string, i bigint, line string")
    for block in (1, 16, 10_000):
        tail = tail_lines(lines_from_table(frame, F.col("s"), F.col("i"), F.col("line"), block), max_lines, max_bytes)
        got = {s: [r.line for r in tail.filter(F.col("source") == s).orderBy(F.col("back").desc()).collect()] for s in texts}
        for s, text in texts.items():
            size = len(text.encode())
            kept = [line.strip() for at, line in offsets(text) if max_bytes is None or at >= max(size - max_bytes, 0)]
            assert got[s] == [line for line in kept if line][-max_lines:]


def test_slow_log_snapshot_keeps_all_digests(spark):
    """One instance, without a name, holds nearly all digests."""
    frame = spark.range(1500).select(
        F.when(F.col("id") >= 1490, "cold").alias("instance"),
        F.concat(F.lit("f"), F.format_string("%04d", "id")).alias("fingerprint"),
        F.lit("s").alias("sample_sql"),
        F.lit(2).cast("bigint").alias("count"),
        (F.col("id") % 50).cast("double").alias("total_query_time_secs"),
        F.lit(0.0).alias("total_lock_time_secs"),
        F.lit(0).cast("bigint").alias("total_rows_sent"),
        F.lit(0).cast("bigint").alias("total_rows_examined"),
    )
    segment = spark.createDataFrame([(None, 5), (None, 6), ("cold", 1), ("idle", 3)], "instance string, bytes bigint")
    got = {r["instance"]: r for r in rows(slow_log_snapshot(segment, frame, ["instance"]))}
    hot = got[None]
    assert (hot["collected_bytes"], hot["parsed_entries"], hot["digest_count"]) == (11, 2980, 1490)
    want = sorted(((-(i % 50), f"f{i:04d}") for i in range(1490)))
    assert [d["fingerprint"] for d in hot["digests"]] == [name for _, name in want]
    assert got["cold"]["digest_count"] == 10 and got["idle"]["digests"] == [] and got["idle"]["parsed_entries"] == 0


def test_top_n_plans_cut_before_the_shuffle(spark):
    tables = spark.range(1000).selectExpr("concat('i', id % 3) AS instance", "'app' AS table_schema", "cast(id AS string) AS table_name",
                                          "'E' AS engine", "'1' AS table_rows", "cast(id AS string) AS data_length", "'0' AS index_length")
    whole = table_sizes_mysql(tables, 5)
    assert "TakeOrderedAndProject" in whole._jdf.queryExecution().executedPlan().toString()
    assert [r.total_length for r in whole.orderBy("rank").collect()] == [999, 998, 997, 996, 995]
    fleet = table_sizes_mysql(tables, 2, ["instance"])
    assert fleet._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    assert sorted((r.instance, r.total_length) for r in fleet.collect()) == [("i0", 996), ("i0", 999), ("i1", 994), ("i1", 997), ("i2", 995), ("i2", 998)]


def test_small_expressions(spark):
    words = spark.createDataFrame([(" ON\t",), ("1",), ("True",), ("yes ",), ("off",), ("2",), ("",)], "w string")
    assert [r.t for r in words.select(is_truthy(F.col("w")).alias("t")).collect()] == [True] * 4 + [False] * 3
    spaces = spark.createDataFrame([("   a​b 　\x85\r\n",), ("  ",)], "w string")
    assert [r.t for r in spaces.select(strip_ws(F.col("w")).alias("t")).collect()] == ["a​b", ""]
    numbers = spark.createDataFrame([("5",), ("+5",), ("-5",), ("5.0",), ("9223372036854775808",), ("NULL",), (None,)], "w string")
    assert [r.t for r in numbers.select(unsigned_or_zero(F.col("w")).alias("t")).collect()] == [5, 5, 0, 0, 0, 0, 0]
    doubles = spark.createDataFrame([("1.5",), (".5",), ("5.",), ("1e3",), ("1.5d",), (" 1",), (".",), ("-inf",)], "w string")
    assert [r.t for r in doubles.select(parse_double(F.col("w")).alias("t")).collect()] == [1.5, 0.5, 5.0, 1000.0, None, None, None, float("-inf")]
    pairs = spark.range(1).select(F.create_map(F.lit("a"), F.lit("x")).alias("m"))
    assert tuple(pairs.select(text_or_empty(F.col("m"), "a"), text_or_empty(F.col("m"), "b")).first()) == ("x", "")


def test_log_paths(spark):
    base = {"logging_collector": "on", "data_directory": "/d", "log_directory": "log", "log_filename": "pg.log"}
    settings = {"exact": base, "pattern": base | {"log_filename": "pg-%d.log"}, "gone": base | {"log_filename": "x.log"}, "off": base | {"logging_collector": "off"},
                "nodir": {k: v for k, v in base.items() if k != "data_directory"} | {"log_directory": "/abs"}, "hidden": base}
    rows_ = [(name, "postgres", key, value) for name, values in settings.items() for key, value in values.items()]
    rows_ += [("my", "mysql", "slow_query_log_file", "/s.log"), ("my", "mysql", "log_error", "stderr")]
    files = [(name, "/d/log", f"/d/log/{file}", at) for name in settings for file, at in (("pg.log", 1), ("new.log", 2))]
    files += [("nodir", "/abs", "/abs/z.log", 1)]
    found = resolve_log_paths(
        spark.createDataFrame(rows_, "instance string, engine string, name string, value string"),
        spark.createDataFrame(files, "instance string, dir string, path string, modification_time int"),
        spark.createDataFrame([("hidden", "  ", None), ("off", None, "/e.log")], "instance string, slow_log_path string, error_log_path string"),
    )
    assert {r.instance: (r.slow_log_path, r.error_log_path) for r in found.collect()} == {
        "exact": ("/d/log/pg.log", "/d/log/pg.log"), "pattern": ("/d/log/new.log", "/d/log/new.log"), "gone": ("/d/log/new.log", "/d/log/new.log"),
        "off": (None, "/e.log"), "nodir": (None, None), "hidden": (None, None), "my": ("/s.log", None),
    }


def test_null_groups_stay(spark):
    from dbgauge.operators.alerts import alerts
    from dbgauge.operators.snapshots import error_log_snapshot

    data = [(None, 0, "deadlock one"), (None, 1, "deadlock two"), ("a", 0, "purge"), ("b", 0, "calm")]
    frame = spark.createDataFrame(data, "instance string, i bigint, line string")
    lines = lines_from_table(frame, F.coalesce("instance", F.lit("-")), F.col("i"), F.col("line")).withColumn("instance", F.nullif("source", F.lit("-")))
    found = alerts(lines, ["instance"])
    assert {(r.instance, r.category, r["count"], tuple(r.sample_lines)) for r in found.collect()} == {(None, "deadlock", 2, ("deadlock one", "deadlock two")), ("a", "purge", 1, ("purge",))}
    snapshot = error_log_snapshot(lines, found, ["instance"])
    assert {(r.instance, r.sampled_lines, r.alert_count) for r in snapshot.collect()} == {(None, 2, 1), ("a", 1, 1), ("b", 1, 0)}


def test_catalog_numbers_are_strict(spark):
    values = ["5", " 5 ", "-5", "+7", "1.5", "x", None, "18446744073709551615"]
    frame = spark.createDataFrame([("i", "app", f"t{n}", "E", v, "0", "0") for n, v in enumerate(values)], "instance string, table_schema string, table_name string, engine string, table_rows string, data_length string, index_length string")
    got = {r.table_name: r.table_rows for r in table_sizes_mysql(frame).collect()}
    assert [got[f"t{n}"] for n in range(len(values))] == [5, 0, 0, 7, 0, 0, 0, 0]


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from dbgauge.session import shared_dir

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://shared")) == "hdfs://shared"
    assert shared_dir(session("local[4]")) == shared_dir(session("local[*]"))
