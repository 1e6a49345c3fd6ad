"""Operator inputs rendered from the given tables, inside Spark.

The tables hold no logs or snapshots. Each function turns whole tables into the text or rows a fleet
would land, so that the work of a query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.sources.logs import lines_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows over the shuffle partitions before text is rendered from them.

    Rendering costs far more than the rows it starts from, and the tables have few splits. The plan is the same at every size.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def instance_of(user: str = "user_id") -> Column:
    """Ten instances; which one a row belongs to follows from its user."""
    return F.concat(F.lit("db-"), (F.col(user) % 10).cast("string"))


def iso_time(name: str = "ts") -> Column:
    return F.concat(F.replace(F.col(name).cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def slow_records(events: DataFrame) -> DataFrame:
    """Events as slow-log records (without the leading mark), with instance and position."""
    k = F.get_json_object("props", "$.k")
    record = F.concat(
        F.lit(" "),
        iso_time(),
        F.lit("\n# User@Host: app[app] @ localhost []\n# Query_time: "),
        F.col("value").cast("string"),
        F.lit(" Lock_time: 0.001 Rows_sent: "),
        k,
        F.lit(" Rows_examined: "),
        F.col("user_id").cast("string"),
        F.lit("\nSET timestamp=1704067200;\nSELECT * FROM "),
        F.col("event_type"),
        F.lit(" WHERE user_id = "),
        F.col("user_id").cast("string"),
        F.lit("\n  AND name = 'u"),
        F.col("user_id").cast("string"),
        F.lit("';"),
    )
    return spread(events, "event_id").select(
        instance_of().alias("instance"),
        instance_of().alias("source"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("event_id").alias("mid"),
        record.alias("record"),
    )


def pg_texts() -> Column:
    """Array of the log lines of one event.

    Odd events put the duration on a line of its own; every seventh event adds a noise line, which
    parts duration and statement of odd events.
    """
    head = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit(" UTC [7] app@db "))
    unit = F.when(F.col("event_id") % 4 == 0, " s").when(F.col("event_id") % 4 == 2, " us").otherwise(" ms")
    sql = F.concat(F.lit("SELECT * FROM "), F.col("event_type"), F.lit(" WHERE id = "), F.col("event_id").cast("string"), F.lit(";"))
    duration = F.concat(head, F.lit("LOG:  duration: "), F.col("value").cast("string"), unit)
    noise = F.concat(head, F.lit("LOG:  checkpoint starting: time"))
    odd = F.col("event_id") % 2 == 1
    seventh = F.col("event_id") % 7 == 0
    statement = F.concat(head, F.lit("STATEMENT:  "), sql)
    one_line = F.concat(duration, F.lit("  statement: "), sql)
    return (
        F.when(odd & seventh, F.array(duration, noise, statement))
        .when(odd, F.array(duration, statement))
        .when(seventh, F.array(one_line, noise))
        .otherwise(F.array(one_line))
    )


def pg_lines(events: DataFrame) -> DataFrame:
    lines = spread(events, "event_id").select("user_id", "event_id", F.posexplode(pg_texts()).alias("at", "line"))
    return lines_from_table(lines, F.col("user_id"), F.col("event_id") * 4 + F.col("at"), F.col("line"))


def error_text() -> Column:
    """Error-log line of one event; error events carry a phrase, the fourth kind falls in two categories."""
    kind = F.col("event_id") % 6
    phrase = (
        F.when(F.col("event_type") != "error", "connection closed")
        .when(kind == 0, "InnoDB: Deadlock found when trying to get lock")
        .when(kind == 1, "InnoDB: Starting CRASH recovery from checkpoint")
        .when(kind == 2, "InnoDB: purge lag increased")
        .when(kind == 3, "replica SQL thread waits for purge")
        .when(kind == 4, "redo done at 0/1F")
        .otherwise("query timeout")
    )
    return F.concat(iso_time(), F.lit(" "), F.col("event_id").cast("string"), F.lit(" [Note] "), phrase)


def error_lines(events: DataFrame) -> DataFrame:
    """All events as one error log."""
    return lines_from_table(spread(events, "event_id").select("event_id", error_text().alias("line")), F.lit("error.log"), F.col("event_id"), F.col("line"))


def instance_error_lines(events: DataFrame) -> DataFrame:
    lines = spread(events, "event_id").select("event_id", instance_of().alias("instance"), error_text().alias("line"))
    placed = lines_from_table(lines, F.col("instance"), F.col("event_id"), F.col("line"))
    return placed.withColumn("instance", F.col("source"))


def land_document_files(spark: SparkSession, sf_dir: str, path: str, per_file: int = 100) -> None:
    """Documents, in order, as the text of log files of ``per_file`` documents each: ``file=<n>/part-*``."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / per_file).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    spread(rows, "file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of each document, the document being the log file."""
    lines = spread(documents, "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines_from_table(lines, F.col("doc_id"), F.col("at"), F.col("line"), block_rows=256)
