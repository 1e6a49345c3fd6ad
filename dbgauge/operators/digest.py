"""Slow-SQL digests: entries grouped by statement fingerprint and ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbgauge.functions.sqltext import fingerprint
from dbgauge.operators.ranking import top_per_group
from dbgauge.schemas import POSITION

_EXACT = "decimal(20,9)"
_MAX_BIGINT = 9_223_372_036_854_775_807


def exact_total(name: str) -> Column:
    """Sum of a DOUBLE column that does not depend on row order.

    Values are summed as decimals; those a decimal cannot hold (infinities, NaN) are summed apart.
    """
    exact = F.col(name).try_cast(_EXACT)
    rest = F.sum(F.when(exact.isNull(), F.col(name)))
    return F.coalesce(F.sum(exact), F.lit(0).cast(_EXACT)).cast("double") + F.coalesce(rest, F.lit(0.0))


def rank_micros(total: Column) -> Column:
    """Total seconds as whole microseconds: NaN and negatives are 0, too large is the maximum."""
    micros = total * 1_000_000
    return (
        F.when(F.isnan(micros) | (micros < 0), F.lit(0).cast("bigint"))
        .when(micros >= float(_MAX_BIGINT), F.lit(_MAX_BIGINT))
        .otherwise(micros.try_cast("bigint"))
    )


def digest_order() -> list[Column]:
    return [rank_micros(F.col("total_query_time_secs")).desc(), F.col("count").desc(), F.col("fingerprint").asc()]


def digest_measures(position: Sequence[str] = POSITION) -> list[Column]:
    return [
        F.min_by("sql", F.struct(*position)).alias("sample_sql"),
        F.count("*").alias("count"),
        exact_total("query_time_secs").alias("total_query_time_secs"),
        exact_total("lock_time_secs").alias("total_lock_time_secs"),
        F.sum("rows_sent").alias("total_rows_sent"),
        F.sum("rows_examined").alias("total_rows_examined"),
    ]


def digest_columns(by: Sequence[str]) -> list[Column]:
    average = F.col("total_query_time_secs") / F.col("count")
    return [
        *[F.col(name) for name in by],
        F.col("fingerprint"),
        F.col("sample_sql"),
        F.col("count"),
        F.col("total_query_time_secs"),
        average.alias("avg_query_time_secs"),
        F.col("total_lock_time_secs"),
        F.col("total_rows_sent"),
        F.col("total_rows_examined"),
    ]


def digest(entries: DataFrame, by: Sequence[str] = (), position: Sequence[str] = POSITION) -> DataFrame:
    """One row per ``by`` and fingerprint; ``sample_sql`` is the first statement by position.

    One shuffle, of partial results. The text sample makes Spark aggregate by sorting; the hash as
    the leading key keeps that sort from comparing long, alike fingerprints.
    """
    keyed = entries.withColumn("fingerprint", fingerprint(F.col("sql")))
    grouped = keyed.groupBy(F.xxhash64("fingerprint").alias("_hash"), *by, "fingerprint").agg(*digest_measures(position))
    return grouped.select(*digest_columns(by))


_SUMS = {"query": "query_time_secs", "lock": "lock_time_secs"}


def digest_parts(entries: DataFrame, by: Sequence[str] = (), position: Sequence[str] = POSITION) -> DataFrame:
    """Totals to keep, for example by day: they merge, so the digests of a longer time need no log to be parsed again.

    One row per ``by`` and fingerprint: the first statement with its position, the count, seconds as exact decimals (and apart, as doubles, those a
    decimal cannot hold), and row totals. ``merge_digest_parts`` makes digests of any number of them.
    """
    keyed = entries.withColumn("fingerprint", fingerprint(F.col("sql")))
    seconds = []
    for short, name in _SUMS.items():
        exact = F.col(name).try_cast(_EXACT)
        seconds += [F.sum(exact).alias(f"{short}_exact"), F.sum(F.when(exact.isNull(), F.col(name))).alias(f"{short}_rest")]
    return keyed.groupBy(F.xxhash64("fingerprint").alias("_hash"), *by, "fingerprint").agg(
        F.min(F.struct(*position, "sql")).alias("first"),
        F.count("*").alias("count"),
        *seconds,
        F.sum("rows_sent").alias("rows_sent"),
        F.sum("rows_examined").alias("rows_examined"),
    ).drop("_hash")


def merge_digest_parts(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The digests of all entries that the parts were made of, in groups ``by`` (some of the parts' own columns)."""
    seconds = []
    for short, name in _SUMS.items():
        exact = F.coalesce(F.sum(f"{short}_exact"), F.lit(0).cast(_EXACT)).cast("double")
        seconds.append((exact + F.coalesce(F.sum(f"{short}_rest"), F.lit(0.0))).alias(f"total_{name}"))
    merged = parts.groupBy(F.xxhash64("fingerprint").alias("_hash"), *by, "fingerprint").agg(
        F.min("first")["sql"].alias("sample_sql"),
        F.sum("count").alias("count"),
        *seconds,
        F.sum("rows_sent").alias("total_rows_sent"),
        F.sum("rows_examined").alias("total_rows_examined"),
    )
    return merged.select(*digest_columns(by))


def rank_digests(digests: DataFrame, by: Sequence[str] = (), top_n: int | None = None) -> DataFrame:
    """Order digests by total time (whole microseconds), count, fingerprint.

    With ``top_n`` the first of each group, with their ``rank``. Without it all digests, sorted by group
    and order: a range-partitioned sort, which splits a group of any size over many tasks.
    """
    if top_n is not None:
        return top_per_group(digests, by, digest_order(), top_n, spread_on=["fingerprint"] if by else ())
    return digests.orderBy(*by, *digest_order())
