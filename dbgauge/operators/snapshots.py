"""Per-instance log snapshots: counters with the ranked digests or alerts nested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbgauge.operators.digest import digest_columns, rank_micros
from dbgauge.operators.joins import join_groups

DIGEST_FIELDS = [
    "fingerprint",
    "sample_sql",
    "count",
    "total_query_time_secs",
    "avg_query_time_secs",
    "total_lock_time_secs",
    "total_rows_sent",
    "total_rows_examined",
]


def slow_log_counters(segment: DataFrame, digests: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per instance: collected_bytes, parsed_entries, digest_count.

    ``segment(<by>, bytes)`` are the collected lines or records; an instance with none has no row. The digests
    themselves stay a table, of any length; ``rank_digests`` orders it.
    """
    keys = list(by)
    read = segment.groupBy(*keys).agg(F.sum("bytes").alias("collected_bytes"))
    counted = digests.groupBy(*keys).agg(F.sum("count").alias("parsed_entries"), F.count("*").alias("digest_count"))
    return join_groups(read, counted, keys, "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in ("parsed_entries", "digest_count")})


def slow_log_snapshot(segment: DataFrame, digests: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counters, and all ranked digests nested in one row, as the record of one collection holds them.

    For the edge where records are made: a row is as long as its instance has digests.
    """
    keys = list(by)
    order = F.struct((-rank_micros(F.col("total_query_time_secs"))).alias("micros"), (-F.col("count")).alias("entries"), "fingerprint", F.struct(*DIGEST_FIELDS).alias("item"))
    ranked = F.transform(F.array_sort(F.collect_list(order)), lambda entry: entry["item"])
    lists = digests.select(*digest_columns(keys)).groupBy(*keys).agg(ranked.alias("digests"))
    none = F.array().cast("array<struct<fingerprint:string,sample_sql:string,count:bigint,total_query_time_secs:double,"
                          "avg_query_time_secs:double,total_lock_time_secs:double,total_rows_sent:bigint,"
                          "total_rows_examined:bigint>>")
    counters = slow_log_counters(segment, digests, keys)
    return join_groups(counters, lists, keys, "left").withColumn("digests", F.coalesce("digests", none))


def error_log_snapshot(lines: DataFrame, alert_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per instance: sampled_lines, alert_count, alerts. ``lines`` are the sampled lines."""
    keys = list(by)
    read = lines.groupBy(*keys).agg(F.count("*").alias("sampled_lines"))
    order = F.struct((-F.col("count")).alias("rank"), "category", F.struct("category", "count", "sample_lines").alias("item"))
    nested = alert_rows.groupBy(*keys).agg(
        F.count("*").alias("alert_count"),
        F.transform(F.array_sort(F.collect_list(order)), lambda entry: entry["item"]).alias("alerts"),
    )
    none = F.array().cast("array<struct<category:string,count:bigint,sample_lines:array<string>>>")
    return join_groups(read, nested, keys, "left").select(
        *keys,
        "sampled_lines",
        F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
        F.coalesce("alerts", none).alias("alerts"),
    )
