"""Streaming queries: tables are landed as log files and read as a stream until all is processed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.operators.alerts import alert_parts, merge_alert_parts
from dbgauge.operators.digest import digest_parts, merge_digest_parts
from dbgauge.operators.slowlog import log_line_time
from dbgauge.plans.inputs import error_text, pg_texts, slow_records, spread, table
from dbgauge.session import scratch_path
from dbgauge.sources.ranges import locate
from dbgauge.streaming import (
    ingest_logs,
    ingest_pg_logs,
    ingest_pg_series,
    late_rows,
    read_entry_stream,
    read_growing_lines,
    read_increments,
    read_line_stream,
    read_windows,
    stream_alerts,
    stream_digests,
    untimed_entries,
    write_increments,
    write_windows,
)

# What is landed last, so that the watermark passes all windows of the tables. Its own window stays open.
_CLOSING_RECORD = "# Time: 2100-01-01T00:00:00Z\n# Query_time: 0\nSELECT 1;"
_CLOSING_LINE = "2100-01-01T00:00:00Z 0 [Note] deadlock"


def _land_records(events: DataFrame, path: str) -> None:
    slow_records(events).select(F.concat(F.lit("# Time:"), F.col("record")).alias("value")).write.mode("append").text(path)


def _land_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").write.mode("append").text(path)


def _start() -> list:
    return [F.unix_seconds(F.col("window.start")).alias("window_start"), F.unix_seconds(F.col("window.end")).alias("window_end")]


def _windows(spark: SparkSession, base: str, landings: list, **options) -> DataFrame:
    """Ingest and window each landing in a run of its own, and then one that closes all windows."""
    for land in [*landings, lambda path: _land_text(spark, _CLOSING_RECORD, path)]:
        land(f"{base}/in")
        ingest_logs(spark, f"{base}/in", f"{base}/entries", f"{base}/ingested").awaitTermination()
        frame = stream_digests(read_entry_stream(spark, f"{base}/entries"), watermark="30 minutes", **options)
        write_windows(frame, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return read_windows(spark, f"{base}/out")


def digests_by_hour(spark: SparkSession, sf_dir: str, slide: str | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = _windows(spark, scratch_path(spark, "stream-digests"), [lambda path: _land_records(events, path)], window="1 hour", slide=slide)
    return found.select(*_start(), "fingerprint", "sample_sql", "count", "total_query_time_secs", "total_rows_sent", "total_rows_examined")


def digests_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_by_hour(spark, sf_dir, "30 minutes").select("window_start", "fingerprint", "count", "total_query_time_secs")


def digest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a fingerprint: its entries with less than a minute between them."""
    events = table(spark, sf_dir, "events")
    found = _windows(spark, scratch_path(spark, "stream-sessions"), [lambda path: _land_records(events, path)], window="1 minute", kind="session")
    return found.select(F.unix_micros("window.start").alias("session_start"), "fingerprint", "count", "total_query_time_secs")


def digests_with_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events land first; of the even ones, those in windows that the watermark has passed are dropped."""
    events = table(spark, sf_dir, "events")
    odd = F.col("event_id") % 2 == 1
    landings = [lambda path, part=part: _land_records(part, path) for part in (events.filter(odd), events.filter(~odd))]
    found = _windows(spark, scratch_path(spark, "stream-late"), landings, window="1 hour")
    return found.select("fingerprint", F.unix_seconds("window.start").alias("window_start"), "count")


def untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth record has no readable time: in no window, but counted."""
    base = scratch_path(spark, "stream-untimed")
    records = slow_records(table(spark, sf_dir, "events"))
    headless = F.when(F.col("mid") % 9 == 0, F.regexp_replace("record", "^[^\n]*", " unknown")).otherwise(F.col("record"))
    records.select(F.concat(F.lit("# Time:"), headless).alias("value")).write.text(f"{base}/in")
    ingest_logs(spark, f"{base}/in", f"{base}/entries", f"{base}/ingested").awaitTermination()
    write_windows(untimed_entries(read_entry_stream(spark, f"{base}/entries")), f"{base}/out", f"{base}/checkpoint", "complete").awaitTermination()
    return read_windows(spark, f"{base}/out", mode="complete")


def alerts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-alerts")
    lines = table(spark, sf_dir, "events").select(error_text().alias("value"))
    for land in (lambda path: lines.write.text(path), lambda path: _land_text(spark, _CLOSING_LINE, path)):
        land(f"{base}/in")
        frame = stream_alerts(read_line_stream(spark, f"{base}/in"), "1 day", "1 hour")
        write_windows(frame, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return read_windows(spark, f"{base}/out").select(*_start(), "category", "count", "sample_line")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landings, two runs over one checkpoint: each file must be read exactly once."""
    base = scratch_path(spark, "ingest")
    events = table(spark, sf_dir, "events")
    early = F.col("event_type").isin("click", "view")
    for landing in (events.filter(early), events.filter(~early)):
        _land_records(landing, f"{base}/in")
        ingest_logs(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    entries = spark.read.parquet(f"{base}/out")
    return entries.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("entries"), F.sum("rows_examined").alias("rows_examined")
    )


def _land_growth(lines: DataFrame, path: str, cut: int = 0) -> None:
    """Write files whole: lines (file, flag, at, value) in order, each in the file ``<file>.log``, without the last ``cut`` bytes.

    Written again with more lines, a file has grown as if they had been appended. One file is one writer's, as on a server.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((name, value) for batch in batches for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()))
        for name, group in groupby(rows, itemgetter(0)):
            system, folder = locate(path)
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{name}.log") as out:
                held = b""
                for _, value in group:
                    held += f"{value}\n".encode()
                    if len(held) > 1 << 20:
                        out.write(held[:-cut] if cut else held)
                        held = held[-cut:] if cut else b""
                out.write(held[:-cut] if cut else held)
            yield pa.RecordBatch.from_pydict({"file": [name]})

    ordered = spread(lines, "file").sortWithinPartitions("file", "flag", "at")
    ordered.select("file", "value").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def growing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error logs that grow between three runs of a stream over one checkpoint; in the last, every third file was rotated.

    The first landing ends within a line, which is to come whole with the second. Each line has to come once.
    """
    base = scratch_path(spark, "growing")
    lines = table(spark, sf_dir, "events").select(
        F.concat(F.lit("server-"), F.floor(F.col("event_id") / 1000).cast("string")).alias("file"),
        (F.col("event_id") % 3).alias("flag"),
        F.col("event_id").alias("at"),
        error_text().alias("value"),
    )
    rotated = (F.floor(F.col("at") / 1000) % 3 == 0) & (F.col("flag") < 2)
    for landing, cut in ((lines.filter("flag < 1"), 5), (lines.filter("flag < 2"), 0), (lines.filter(~rotated), 0)):
        _land_growth(landing, f"{base}/in", cut)
        found = read_growing_lines(spark, f"{base}/in")
        writer = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.regexp_extract("source", r"([^/]+)\.log$", 1).alias("file"), "mid", "line")


def _placed_entries(spark: SparkSession, sf_dir: str, label: str) -> str:
    """Digests of hours by increments: odd events land first, then even ones, then what closes all windows. Returns where they are."""
    base = scratch_path(spark, label)
    events = table(spark, sf_dir, "events")
    odd = F.col("event_id") % 2 == 1
    landings = [lambda path, part=part: _land_records(part, path) for part in (events.filter(odd), events.filter(~odd))]
    for land in [*landings, lambda path: _land_text(spark, _CLOSING_RECORD, path)]:
        land(f"{base}/in")
        ingest_logs(spark, f"{base}/in", f"{base}/entries", f"{base}/ingested").awaitTermination()
        entries = read_entry_stream(spark, f"{base}/entries")
        parts = lambda rows, by: digest_parts(rows, by, ["ts"])
        write_increments(entries, f"{base}/out", f"{base}/checkpoint", parts, "1 hour", "0 00:30:00").awaitTermination()
    return f"{base}/out"


def digests_by_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows and late rows as ``stream_digests_late``."""
    found = read_increments(spark, _placed_entries(spark, sf_dir, "increments"), merge_digest_parts)
    return found.select("fingerprint", F.unix_seconds("window_start").alias("window_start"), "count", "total_query_time_secs")


def rows_too_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hour, the number of rows that its window left out because they came behind the watermark."""
    found = late_rows(spark, _placed_entries(spark, sf_dir, "late-rows"))
    return found.select(F.unix_seconds("window_start").alias("window_start"), "late_rows")


def alert_samples_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error logs that grow in three steps: counts by day, and the first three lines by position, as in one file."""
    base = scratch_path(spark, "alert-samples")
    lines = table(spark, sf_dir, "events").select(
        F.concat(F.lit("error-"), F.lpad(F.floor(F.col("event_id") / 1000).cast("string"), 12, "0")).alias("file"),
        F.floor(F.pmod("event_id", F.lit(1000)) / 400).alias("flag"),
        F.col("event_id").alias("at"),
        error_text().alias("value"),
    )
    for step in (0, 1, 2):
        _land_growth(lines.filter(F.col("flag") <= step), f"{base}/in")
        if step == 2:
            _land_text(spark, _CLOSING_LINE, f"{base}/in/last")
        found = read_growing_lines(spark, f"{base}/in").withColumn("ts", log_line_time(F.col("line")))
        # files of many days are read in each step, so nothing may be late before the last
        write_increments(found, f"{base}/out", f"{base}/checkpoint", alert_parts, "1 day", "10000 00:00:00" if step < 2 else "0 01:00:00").awaitTermination()
    return read_increments(spark, f"{base}/out", merge_alert_parts).select(
        F.unix_seconds("window_start").alias("window_start"), "category", "count", F.array_join("sample_lines", "|").alias("sample_lines")
    )


def pg_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement log in chunks that part durations from their statements, some of them between two runs."""
    base = scratch_path(spark, "pg-series")
    place = F.col("event_id") * 4 + F.col("at") + 3
    lines = table(spark, sf_dir, "events").select("event_id", F.posexplode(pg_texts()).alias("at", "value"))
    chunk = F.floor(place / 4000)
    lines = lines.select(F.concat(F.lit("pg-"), F.lpad(chunk.cast("string"), 12, "0")).alias("file"), F.pmod(chunk, F.lit(1)).alias("flag"), place.alias("at"), chunk.alias("chunk"), "value")
    last = lines.agg(F.max("chunk")).first()[0] or 0
    for step in (1, 2, 3):
        low, high = (last + 1) * (step - 1) // 3, (last + 1) * step // 3
        _land_growth(lines.filter((F.col("chunk") >= low) & (F.col("chunk") < high)), f"{base}/in")
        found = read_growing_lines(spark, f"{base}/in")
        ingest_pg_series(spark, found, f"{base}/out", f"{base}/checkpoint", f"{base}/pending").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sql", "query_time_secs")


def pg_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-pg")
    lines = table(spark, sf_dir, "events").select("event_id", F.posexplode(pg_texts()).alias("at", "value"))
    # One file for each range of events, its lines in order.
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id", "at").select("value").write.text(f"{base}/in")
    ingest_pg_logs(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sql", "query_time_secs")


QUERIES = {
    "stream_digests": digests_by_hour,
    "stream_digests_sliding": digests_sliding,
    "stream_digests_session": digest_sessions,
    "stream_digests_late": digests_with_late_rows,
    "stream_untimed": untimed,
    "stream_alerts": alerts_by_day,
    "ingest_logs": ingested,
    "stream_growing_files": growing_lines,
    "stream_digest_increments": digests_by_increments,
    "stream_late_rows": rows_too_late,
    "stream_alert_samples": alert_samples_by_day,
    "stream_pg_series": pg_series,
    "stream_pg_entries": pg_entries,
}

_SHAPE = "'select * from ' || event_type || ' where user_id = ? and name = ?;'"
_SQL = "'SELECT * FROM ' || event_type || ' WHERE user_id = ' || user_id || chr(10) || 'AND name = ''u' || user_id || ''';'"
_TOTAL = "CAST(sum(CAST(value AS DECIMAL(20,9))) AS DOUBLE) AS total_query_time_secs"
_HOUR = "CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT)"
_HALF = "CAST(epoch(time_bucket(INTERVAL 30 MINUTE, ts)) AS BIGINT)"

_PG_PAIRS = """
SELECT 'SELECT * FROM ' || event_type || ' WHERE id = ' || event_id || ';' AS sql,
  CASE event_id % 4 WHEN 0 THEN value WHEN 2 THEN value / 1000000 ELSE value / 1000 END AS query_time_secs
FROM events WHERE event_id % 2 = 0 OR event_id % 7 <> 0"""
_MARK = "WITH w AS (SELECT CAST(epoch(max(ts)) AS BIGINT) - 1800 AS mark FROM events WHERE event_id % 2 = 1)"

ORACLES = {
    "stream_digest_increments": f"""{_MARK}
SELECT {_SHAPE} AS fingerprint, {_HOUR} AS window_start, count(*) AS count, {_TOTAL} FROM events, w WHERE event_id % 2 = 1 OR {_HOUR} + 3600 > mark GROUP BY ALL""",
    "stream_late_rows": f"""{_MARK}
SELECT {_HOUR} AS window_start, CAST(count(*) AS BIGINT) AS late_rows FROM events, w WHERE event_id % 2 = 0 AND {_HOUR} + 3600 <= mark GROUP BY ALL""",
    "stream_pg_series": _PG_PAIRS,
    "stream_alert_samples": """
WITH e AS (
  SELECT ts, event_id, event_id % 6 AS kind, replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z ' || event_id || ' [Note] ' || CASE event_id % 6
    WHEN 0 THEN 'InnoDB: Deadlock found when trying to get lock' WHEN 1 THEN 'InnoDB: Starting CRASH recovery from checkpoint'
    WHEN 2 THEN 'InnoDB: purge lag increased' WHEN 3 THEN 'replica SQL thread waits for purge' WHEN 4 THEN 'redo done at 0/1F' END AS line
  FROM events WHERE event_type = 'error'
), c AS (
  SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, category, line, event_id,
    row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 DAY, ts), category ORDER BY event_id) AS rn
  FROM e JOIN (VALUES (0, 'deadlock'), (1, 'crash_recovery'), (2, 'purge'), (3, 'purge'), (3, 'replication'), (4, 'crash_recovery')) k(kind, category) USING (kind)
)
SELECT window_start, category, count(*) AS count, string_agg(line, '|' ORDER BY event_id) FILTER (WHERE rn <= 3) AS sample_lines FROM c GROUP BY ALL""",
    "stream_digests": f"""
SELECT {_HOUR} AS window_start, {_HOUR} + 3600 AS window_end, {_SHAPE} AS fingerprint, arg_min({_SQL}, (ts, {_SQL})) AS sample_sql, count(*) AS count,
  {_TOTAL}, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_rows_sent, CAST(sum(user_id) AS BIGINT) AS total_rows_examined
FROM events GROUP BY ALL""",
    "stream_digests_sliding": f"""
SELECT {_HALF} - shift AS window_start, {_SHAPE} AS fingerprint, count(*) AS count, {_TOTAL}
FROM events, (VALUES (0), (1800)) v(shift) GROUP BY ALL""",
    "stream_digests_session": f"""
WITH g AS (
  SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events
), n AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 1 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM g
)
SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS session_start, {_SHAPE} AS fingerprint, count(*) AS count, {_TOTAL} FROM n GROUP BY event_type, session""",
    "stream_digests_late": f"""
WITH w AS (SELECT CAST(epoch(max(ts)) AS BIGINT) - 1800 AS mark FROM events WHERE event_id % 2 = 1)
SELECT {_SHAPE} AS fingerprint, {_HOUR} AS window_start, count(*) AS count FROM events, w WHERE event_id % 2 = 1 OR {_HOUR} + 3600 > mark GROUP BY ALL""",
    "stream_untimed": "SELECT count(*) FILTER (WHERE event_id % 9 = 0) AS count FROM events",
    "stream_alerts": """
WITH e AS (
  SELECT ts, event_id % 6 AS kind, replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z ' || event_id || ' [Note] ' || CASE event_id % 6
    WHEN 0 THEN 'InnoDB: Deadlock found when trying to get lock' WHEN 1 THEN 'InnoDB: Starting CRASH recovery from checkpoint'
    WHEN 2 THEN 'InnoDB: purge lag increased' WHEN 3 THEN 'replica SQL thread waits for purge' WHEN 4 THEN 'redo done at 0/1F' END AS line
  FROM events WHERE event_type = 'error'
)
SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) + 86400 AS window_end,
  category, count(*) AS count, arg_min(line, (ts, line)) AS sample_line
FROM e JOIN (VALUES (0, 'deadlock'), (1, 'crash_recovery'), (2, 'purge'), (3, 'purge'), (3, 'replication'), (4, 'crash_recovery')) k(kind, category) USING (kind)
GROUP BY ALL""",
    "ingest_logs": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS entries, CAST(sum(user_id) AS BIGINT) AS rows_examined FROM events GROUP BY 1",
    "stream_growing_files": """
WITH e AS (
  SELECT event_id, event_id // 1000 AS n, event_id % 3 AS flag, replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z ' || event_id || ' [Note] ' || CASE
    WHEN event_type <> 'error' THEN 'connection closed' WHEN event_id % 6 = 0 THEN 'InnoDB: Deadlock found when trying to get lock'
    WHEN event_id % 6 = 1 THEN 'InnoDB: Starting CRASH recovery from checkpoint' WHEN event_id % 6 = 2 THEN 'InnoDB: purge lag increased'
    WHEN event_id % 6 = 3 THEN 'replica SQL thread waits for purge' WHEN event_id % 6 = 4 THEN 'redo done at 0/1F' ELSE 'query timeout' END AS line
  FROM events
)
SELECT 'server-' || n AS file, line,
  CAST(sum(strlen(line) + 1) OVER (PARTITION BY n, CASE WHEN n % 3 = 0 AND flag = 2 THEN 1 END ORDER BY flag, event_id) - strlen(line) - 1 AS BIGINT) AS mid FROM e""",
    "stream_pg_entries": _PG_PAIRS,
}
