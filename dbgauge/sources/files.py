"""File listings and log path resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.functions.text import is_truthy, strip_ws


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing ``dir, path, length, modification_time`` of the files under ``path``; contents stay unread."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
            "path",
            "length",
            F.col("modificationTime").alias("modification_time"),
        )
    )


def latest_files(files: DataFrame, by: Sequence[str] = ("dir",)) -> DataFrame:
    """The newest file of each group; of equally new files the greatest path."""
    newest = F.max(F.struct("modification_time", "path")).alias("_newest")
    found = files.groupBy(*by).agg(newest)
    return found.select(*by, F.col("_newest.path").alias("path"), F.col("_newest.modification_time").alias("modification_time"))


# The settings that lead to log paths.
PATH_SETTINGS = [
    "slow_query_log_file",
    "log_error",
    "logging_collector",
    "data_directory",
    "log_directory",
    "log_filename",
]
# Fixed value: an error log "path" that is no file.
NO_FILE = "stderr"


def _filled(path: Column) -> Column:
    """NULL for blank text; other text unchanged."""
    return F.when(strip_ws(path) != "", path)


def _join_path(parent: Column, child: Column) -> Column:
    """``child`` below ``parent``; an absolute ``child`` stands alone."""
    slash = F.when(parent.endswith("/") | (parent == ""), "").otherwise("/")
    return F.when(child.startswith("/"), child).otherwise(F.concat(parent, slash, child))


def resolve_log_paths(settings: DataFrame, files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Slow-log and error-log path of each instance.

    ``settings(instance, engine, name, value)`` holds server settings, ``files(instance, dir, path,
    modification_time)`` listings, ``overrides(instance, slow_log_path, error_log_path)`` configured
    paths. A configured path wins, and a blank one hides the discovered one.
    """
    wide = (
        settings.filter(F.col("name").isin(PATH_SETTINGS))
        .groupBy("instance", "engine")
        .agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in PATH_SETTINGS])
        .withColumn("_dir", _join_path(F.col("data_directory"), F.col("log_directory")))
        .withColumn("_wanted", _join_path(F.col("_dir"), F.col("log_filename")))
    )
    known = files.select("instance", "dir", "path", "modification_time")
    newest = latest_files(known, by=["instance", "dir"]).select("instance", F.col("dir").alias("_dir"), F.col("path").alias("_newest"))
    present = known.select("instance", F.col("path").alias("_wanted"), F.lit(True).alias("_present")).distinct()
    found = (
        wide.join(newest, ["instance", "_dir"], "left")
        .join(present, ["instance", "_wanted"], "left")
        .join(
            overrides.select(
                "instance",
                F.col("slow_log_path").alias("_slow"),
                F.col("error_log_path").alias("_error"),
            ),
            "instance",
            "left",
        )
    )
    mysql = F.col("engine") == "mysql"
    exact = ~F.col("log_filename").contains("%") & F.col("_present")
    located = F.col("data_directory").isNotNull() & F.col("log_directory").isNotNull() & F.col("log_filename").isNotNull()
    landed = F.when(exact, F.col("_wanted")).otherwise(F.col("_newest"))
    statement_log = F.when(is_truthy(F.col("logging_collector")) & located, landed)
    slow = _filled(F.coalesce("_slow", F.when(mysql, _filled(F.col("slow_query_log_file"))).otherwise(statement_log)))
    server_error = F.when(F.col("log_error") != NO_FILE, _filled(F.col("log_error")))
    error = _filled(F.coalesce("_error", F.when(mysql, server_error).otherwise(slow)))
    return found.select("instance", "engine", slow.alias("slow_log_path"), error.alias("error_log_path"))
