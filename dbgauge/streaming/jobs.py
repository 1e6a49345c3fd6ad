"""Structured Streaming over landed log files.

The file source sees new files, not the growth of an old one: rotated chunks are landed as files, or ``streaming.growing`` follows a file.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dbgauge.functions.sqltext import fingerprint
from dbgauge.functions.text import ascii_lower, strip_ws
from dbgauge.operators.alerts import ALERT_RULES, line_categories
from dbgauge.operators.digest import exact_total
from dbgauge.operators.slowlog import log_line_time, pair_across_chunks, parse_mysql_slow_log, parse_pg_statement_log
from dbgauge.sources.logs import RECORD_MARK, drop_leading_text, line_rows, record_rows


def read_entry_stream(spark: SparkSession, entries: str, max_files: int | None = None) -> DataFrame:
    """Entries that ``ingest_logs`` has written, as a stream; the folder has to hold some."""
    reader = spark.readStream.schema(spark.read.parquet(entries).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(entries)


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Log lines ``source, line`` of the files landed in ``path``."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", "").alias("line")
    )


def _window(kind: str, size: str, slide: str | None) -> Column:
    if kind == "session":
        return F.session_window("ts", size)
    return F.window("ts", size, slide) if slide else F.window("ts", size)


def stream_digests(
    entries: DataFrame,
    window: str,
    watermark: str,
    slide: str | None = None,
    kind: str = "fixed",
    by: Sequence[str] = (),
) -> DataFrame:
    """Digests per event-time window: tumbling, sliding with ``slide``, or ``kind="session"``.

    Entries without a time are in no window; ``untimed_entries`` counts them. The sample is the
    statement with the earliest time.
    """
    timed = entries.filter(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    return digest_stream(timed, _window(kind, window, slide), by)


def digest_stream(entries: DataFrame, window: Column, by: Sequence[str] = ()) -> DataFrame:
    """Windowed digests of entries that carry a watermark on ``ts``."""
    grouped = entries.withColumn("fingerprint", fingerprint(F.col("sql"))).groupBy(window.alias("window"), *by, "fingerprint")
    totals = grouped.agg(
        F.min_by("sql", F.struct("ts", "sql")).alias("sample_sql"),
        F.count("*").alias("count"),
        exact_total("query_time_secs").alias("total_query_time_secs"),
        exact_total("lock_time_secs").alias("total_lock_time_secs"),
        F.sum("rows_sent").alias("total_rows_sent"),
        F.sum("rows_examined").alias("total_rows_examined"),
    )
    return totals.withColumn("avg_query_time_secs", F.col("total_query_time_secs") / F.col("count"))


def untimed_entries(entries: DataFrame) -> DataFrame:
    """Number of entries that no window counts because their time is missing or unreadable."""
    return entries.filter(F.col("ts").isNull()).groupBy().agg(F.count("*").alias("count"))


def stream_alerts(
    lines: DataFrame,
    window: str,
    watermark: str,
    slide: str | None = None,
    rules: Mapping[str, Sequence[str]] = ALERT_RULES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Alert counts per event-time window, each with its earliest line as the sample."""
    text = strip_ws(F.col("line"))
    timed = lines.withColumn("line", text).withColumn("ts", log_line_time(F.col("line"))).filter(F.col("ts").isNotNull())
    labelled = timed.withColumn("_lower", ascii_lower(F.col("line"))).withColumn(
        "category", F.explode(line_categories(F.col("_lower"), rules))
    ).filter(F.col("category").isNotNull())
    return (
        labelled.withWatermark("ts", watermark)
        .groupBy(_window("fixed", window, slide).alias("window"), *by, "category")
        .agg(F.count("*").alias("count"), F.min_by("line", F.struct("ts", "line")).alias("sample_line"))
    )


def _utc_day(name: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(name) / 86_400).cast("int"))


def ingest_logs(
    spark: SparkSession, in_dir: str, out: str, checkpoint: str, once: bool = True, interval: str = "60 seconds", max_files: int | None = None
) -> StreamingQuery:
    """Parse every newly landed slow-log file once and append its entries to Parquet, by batch and UTC day.

    The checkpoint remembers what was read, so a restart goes on where the last run ended, and a repeated batch writes over its own
    folder. A batch is an ordinary frame, so the text before a file's first record is told exactly as in
    batch reading. ``once`` reads what is there and ends; otherwise the query looks for new files every ``interval``.
    """
    records = record_rows(_text_stream(spark, in_dir, f"\n{RECORD_MARK}", max_files))
    return _ingest(records, lambda batch: parse_mysql_slow_log(drop_leading_text(batch)), out, checkpoint, once, interval)


def ingest_pg_logs(
    spark: SparkSession, in_dir: str, out: str, checkpoint: str, once: bool = True, interval: str = "60 seconds", max_files: int | None = None
) -> StreamingQuery:
    """The same for PostgreSQL statement logs, read line by line, so files split.

    Pairing looks back one line. A file is whole within one batch, so pairing in the batch is exact.
    """
    return _ingest(line_rows(_text_stream(spark, in_dir, "\n", max_files)), parse_pg_statement_log, out, checkpoint, once, interval)


_PENDING = "series string, secs double, since bigint"


def ingest_pg_series(
    spark: SparkSession,
    lines: DataFrame,
    out: str,
    checkpoint: str,
    pending: str,
    series: Column | None = None,
    order: Column | None = None,
    pending_secs: int = 3600,
    once: bool = True,
    interval: str = "60 seconds",
) -> StreamingQuery:
    """Entries of PostgreSQL statement logs whose chunks come in different batches: from ``read_growing_lines``, or as rotated files.

    A duration at the end of a chunk is paired with the statement at the head of the next one of its series (``log_series``, in ``chunk_order``). What is lent is a
    table below ``pending``, one row per series and batch, read by the next batch; it lapses after ``pending_secs``. A repeated batch reads what the batches
    before it have left and writes over its own folders. The lines of a series are not brought into one task: only edge lines of blocks are.
    """
    out, pending = out.rstrip("/"), pending.rstrip("/")
    spark.createDataFrame([], _PENDING).write.mode("overwrite").parquet(f"{pending}/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        now = int(time.time())
        known = spark.read.schema(f"{_PENDING}, batch bigint").parquet(pending).filter(F.col("batch") < number)
        newest = known.agg(F.max("batch")).first()[0]
        carried = known.filter((F.col("batch") == F.lit(newest)) & (F.col("since") > now - pending_secs)).select("series", "secs", "since")
        rows = batch if "mid" in batch.columns else batch.withColumn("mid", F.monotonically_increasing_id())
        held = rows.persist()
        try:
            entries, lent = pair_across_chunks(held, carried, series, order)
            entries.withColumn("day", _utc_day("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={number}")
            since = carried.select("series", F.col("secs").alias("_secs"), "since")
            aged = lent.join(since, "series", "left").select("series", "secs", F.when(F.col("secs") == F.col("_secs"), F.col("since")).otherwise(now).alias("since"))
            aged.write.mode("overwrite").parquet(f"{pending}/batch={number}")
        finally:
            held.unpersist()

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()


def _text_stream(spark: SparkSession, in_dir: str, separator: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.option("lineSep", separator)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(in_dir)


def _ingest(rows: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    def save(batch: DataFrame, number: int) -> None:
        entries = parse(batch.withColumn("mid", F.monotonically_increasing_id())).withColumn("day", _utc_day("ts"))
        entries.write.mode("overwrite").partitionBy("day").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()


def write_windows(frame: DataFrame, out: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write windowed results batch by batch below ``out``; ``read_windows`` reads them.

    Each batch has a folder of its own, written over if the batch is repeated after a failure. In append mode, a window is
    written once, when the watermark has passed it, and its state is dropped. Complete mode keeps all state and suits small results.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "60 seconds"})).start()


def read_windows(spark: SparkSession, out: str, keys: Sequence[str] = (), mode: str = "append") -> DataFrame:
    """What ``write_windows`` has written: in append mode all batches, in complete mode the last, in update mode the last row of each of ``keys``."""
    written = spark.read.parquet(out)
    if mode == "complete":
        last = written.agg(F.max("batch").alias("_last"))
        written = written.join(last, F.col("batch") == F.col("_last")).drop("_last")
    elif mode == "update":
        values = [name for name in written.columns if name not in (*keys, "batch")]
        last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
        return last.select(*keys, "_last.*")
    return written.drop("batch")
