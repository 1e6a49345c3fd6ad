"""Windows by increments: each batch adds parts that merge, and late rows are counted.

A stateful aggregate of a stream keeps one value per group, so it has no first three lines, and what comes behind its watermark leaves without a trace. Here each
micro-batch is an ordinary frame. What it adds to its windows is written as parts (``alert_parts``, ``digest_parts``), beside the number of rows of each window that
came too late, and the latest time seen. Reading merges the parts of the windows that the watermark has passed. A repeated batch writes over its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WINDOW = ["window_start", "window_end"]


def _before(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema("latest timestamp, delay string, rows bigint, untimed bigint, batch bigint").parquet(path).filter(F.col("batch") < number)


def watermark(spark: SparkSession, out: str, number: int | None = None):
    """Time up to which windows are closed, as of before batch ``number`` (None: of all); NULL without a row that has a time."""
    marks = _before(spark, f"{out.rstrip('/')}/marks", 1 << 62 if number is None else number)
    return marks.agg(F.max(F.col("latest") - F.expr("cast(delay as interval day to second)"))).first()[0]


def write_increments(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    parts: Callable[[DataFrame, list[str]], DataFrame],
    window: str,
    delay: str,
    slide: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Write what each batch of ``rows`` (with ``ts``) adds to its windows: ``parts(rows, by)``, by window_start and window_end.

    ``delay`` is an interval such as ``0 00:30:00``. A row is late in a window that ended at or before the latest time of earlier batches less the delay; it is counted
    there and left out. Rows without a time are counted and in no window.
    """
    out = out.rstrip("/")

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            marks = held.agg(
                F.max("ts").alias("latest"), F.lit(delay).alias("delay"), F.count("*").alias("rows"), F.count_if(F.col("ts").isNull()).alias("untimed")
            )
            mark = watermark(spark, out, number) if number else None
            late = F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark)
            windowed = held.filter(F.col("ts").isNotNull()).withColumn("_window", F.window("ts", window, slide) if slide else F.window("ts", window))
            placed = windowed.select("*", F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), late.alias("_late")).drop("_window")
            added = parts(placed.filter(~F.col("_late")).drop("_late"), WINDOW)
            added.write.mode("overwrite").parquet(f"{out}/parts/batch={number}")
            placed.filter("_late").groupBy(*WINDOW).agg(F.count("*").alias("late_rows")).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            marks.write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
        finally:
            held.unpersist()

    _new_folder(rows.sparkSession, f"{out}/marks")
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "60 seconds"})).start()


def _new_folder(spark: SparkSession, path: str) -> None:
    """An empty table of marks, so that the first batch finds one."""
    empty = spark.createDataFrame([], "latest timestamp, delay string, rows bigint, untimed bigint")
    empty.write.mode("overwrite").parquet(f"{path}/batch=-1")


def read_increments(spark: SparkSession, out: str, merge: Callable[[DataFrame, list[str]], DataFrame], closed: bool = True) -> DataFrame:
    """The merged windows; with ``closed`` those only that the watermark has passed, which no later batch changes."""
    out = out.rstrip("/")
    parts = spark.read.parquet(f"{out}/parts")
    if closed:
        mark = watermark(spark, out)
        parts = parts.filter(F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark))
    return merge(parts.drop("batch"), WINDOW)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came too late for a window, by window."""
    return spark.read.parquet(f"{out.rstrip('/')}/late").groupBy(*WINDOW).agg(F.sum("late_rows").alias("late_rows"))


def untimed_rows(spark: SparkSession, out: str) -> DataFrame:
    """Number of rows, and of those without a time."""
    return _before(spark, f"{out.rstrip('/')}/marks", 1 << 62).agg(F.sum("rows").alias("rows"), F.sum("untimed").alias("untimed"))
