"""Streams give what batch jobs give, and read each file once."""

from pyspark.sql import functions as F

from samples import MYSQL_ERRORS, MYSQL_SLOW, PG_ERRORS, PG_STATEMENTS

from dbgauge.operators.digest import digest
from dbgauge.operators.slowlog import parse_mysql_slow_log, parse_pg_statement_log
from dbgauge.sources.logs import read_log_lines, read_slow_log_records
from dbgauge.streaming import (
    ingest_logs,
    ingest_pg_logs,
    read_entry_stream,
    read_line_stream,
    read_windows,
    stream_alerts,
    stream_digests,
    untimed_entries,
    write_windows,
)

OLD = "/usr/sbin/mysqld started with:\nTcp port: 3306\n# Time: nowhen\n# Query_time: 1\nSELECT 1;\n# Time: 260207 12:30:00\n# Query_time: 2\nSELECT 2;\n"


def run(frame, tmp_path, mode="complete"):
    write_windows(frame, str(tmp_path / "out"), str(tmp_path / "cp"), mode).awaitTermination()
    return read_windows(frame.sparkSession, str(tmp_path / "out"), mode=mode)


def entry_stream(spark, folder, tmp_path, max_files=None):
    out = str(tmp_path / "entries")
    ingest_logs(spark, folder, out, str(tmp_path / "mark"), max_files=max_files).awaitTermination()
    return read_entry_stream(spark, out, max_files)


def test_digests_equal_batch(spark, write, tmp_path):
    path = write(a__log=MYSQL_SLOW, b__log=MYSQL_SLOW.replace("T08:", "T09:"))
    got = run(stream_digests(entry_stream(spark, path, tmp_path, 1), "1 hour", "1 day"), tmp_path)
    batch = digest(parse_mysql_slow_log(read_slow_log_records(spark, path)).withColumn("hour", F.date_trunc("hour", "ts")), ["hour"])
    keys = ["fingerprint", "sample_sql", "count", "total_query_time_secs", "total_lock_time_secs", "total_rows_examined"]
    a = sorted(map(tuple, got.select(F.col("window.start"), *keys).collect()))
    assert a == sorted(map(tuple, batch.select("hour", *keys).collect())) and len(a) == 4


def test_session_windows(spark, write, tmp_path):
    path = write(a__log=MYSQL_SLOW)
    got = run(stream_digests(entry_stream(spark, path, tmp_path), "1 second", "1 day", kind="session"), tmp_path)
    assert got.count() == 3


def test_append_mode_drops_late_rows(spark, write, tmp_path):
    """A window is written once the watermark has passed it; rows behind the watermark are dropped."""
    folder = write(a__log=MYSQL_SLOW)

    def go():
        frame = stream_digests(entry_stream(spark, folder, tmp_path), "1 hour", "1 minute")
        return run(frame, tmp_path, "append")

    go()
    write(b__log=MYSQL_SLOW.replace("2025-11-03", "2025-11-05"))
    go()
    write(c__log=MYSQL_SLOW)
    got = go().groupBy(F.to_date("window.start").cast("string").alias("d")).agg(F.sum("count").alias("n"))
    assert {r.d: r.n for r in got.collect()} == {"2025-11-03": 3}


def test_update_mode_reads_the_last_version(spark, write, tmp_path):
    folder, out = write(a__log=MYSQL_SLOW), str(tmp_path / "out")
    for copies in (1, 2):
        frame = stream_digests(entry_stream(spark, folder, tmp_path), "1 hour", "1 day")
        write_windows(frame, out, str(tmp_path / "cp"), "update").awaitTermination()
        got = read_windows(spark, out, ["window", "fingerprint"], "update")
        assert got.agg(F.sum("count")).first()[0] == 3 * copies
        write(b__log=MYSQL_SLOW)


def test_untimed_entries_are_counted_apart(spark, write, tmp_path):
    path = write(a__log=MYSQL_SLOW, old__log="# Time: \n# Query_time: 1\nSELECT 0;\n" + MYSQL_SLOW)
    got = run(untimed_entries(entry_stream(spark, path, tmp_path)), tmp_path)
    assert got.first()["count"] == 1


def test_alerts_in_both_time_formats(spark, write, tmp_path):
    path = write(a__log=MYSQL_ERRORS, b__log=PG_ERRORS)
    got = run(stream_alerts(read_line_stream(spark, path), "1 day", "1 hour"), tmp_path)
    assert {r.category: r["count"] for r in got.collect()} == {"replication": 4, "crash_recovery": 2, "deadlock": 2, "purge": 2}
    assert got.filter("category = 'deadlock'").first()["sample_line"] == MYSQL_ERRORS.splitlines()[3]


def test_ingest_reads_each_file_once(spark, write, tmp_path):
    out, mark = str(tmp_path / "entries"), str(tmp_path / "mark")
    folder = write(a__log=MYSQL_SLOW)
    for landed, expected in ((None, 3), (None, 3), (OLD, 5), (None, 5)):
        if landed:
            write(b__log=landed)
        ingest_logs(spark, folder, out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == expected


def test_pg_entries_equal_batch(spark, write, tmp_path):
    path = write(a__log=PG_STATEMENTS, b__log="\n\nLOG: duration: 5 ms\n\n STATEMENT: SELECT 1\nduration: 1 s\n")
    ingest_pg_logs(spark, path, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    columns = ["source", "ts", "sql", "query_time_secs", "lock_time_secs", "rows_sent", "rows_examined"]
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "o")).select(*columns).collect()))
    want = sorted(map(str, parse_pg_statement_log(read_log_lines(spark, path)).select(*columns).collect()))
    assert got == want and len(got) == 4
