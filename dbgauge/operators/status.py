"""Name/value snapshots, status rollups and replication status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbgauge.operators.joins import join_groups

from dbgauge.functions.values import as_text

# The database counters summed into the status snapshot.
PG_COUNTERS = [
    "numbackends",
    "xact_commit",
    "xact_rollback",
    "blks_read",
    "blks_hit",
    "tup_returned",
    "tup_fetched",
    "tup_inserted",
    "tup_updated",
    "tup_deleted",
    "deadlocks",
]


def latest_pairs(pairs: DataFrame, by: Sequence[str] = ("instance",)) -> DataFrame:
    """One value per name: of several the one with the highest ``pos``."""
    return pairs.groupBy(*by, "name").agg(F.max_by("value", "pos").alias("value"))


def pairs_to_map(pairs: DataFrame, by: Sequence[str] = ("instance",)) -> DataFrame:
    """One MAP ``pairs`` per group, sorted by name.

    Names are made distinct first, so a group's map is as large as a server's list of settings,
    however often the pairs were landed.
    """
    entries = F.array_sort(F.collect_list(F.struct("name", "value")))
    return latest_pairs(pairs, by).groupBy(*by).agg(F.map_from_entries(entries).alias("pairs"))


def lookup(pairs: DataFrame, names: Sequence[str], by: Sequence[str] = ("instance",)) -> DataFrame:
    """The named settings as columns; NULL where an instance lacks one."""
    wanted = latest_pairs(pairs.filter(F.col("name").isin(list(names))), by)
    return wanted.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in names])


def pg_status_rollup(pg_stat_database: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters summed over databases as ``metric, value`` text: one scan, one aggregate.

    Without ``by`` an empty input still gives every metric as 0.
    """
    sums = [F.coalesce(F.sum(F.col(name).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(name) for name in PG_COUNTERS]
    return pg_stat_database.groupBy(*by).agg(*sums).unpivot(list(by), PG_COUNTERS, "metric", "value")


def pg_replication_status(
    recovery: DataFrame, clients: DataFrame, receivers: DataFrame, by: Sequence[str] = ("instance",)
) -> DataFrame:
    """Recovery flag, number of replication clients and receiver status as ``metric, value``.

    ``recovery`` has one row per group with ``in_recovery``; groups without clients or receiver get
    ``0`` and ``''``. Of several receivers the least status text is taken.
    """
    keys = list(by)
    flags = recovery.groupBy(*keys).agg(F.bool_or("in_recovery").alias("_in_recovery"))
    counted = clients.groupBy(*keys).agg(F.count("*").alias("_clients"))
    receiving = receivers.groupBy(*keys).agg(F.min("status").alias("_status"))
    if keys:
        joined = join_groups(join_groups(flags, counted, keys, "left"), receiving, keys, "left")
    else:
        one = [side.withColumn("_one", F.lit(1)) for side in (flags, counted, receiving)]
        joined = one[0].join(one[1], "_one").join(one[2], "_one")
    return joined.select(
        *keys,
        F.col("_in_recovery").cast("string").alias("is_in_recovery"),
        F.coalesce("_clients", F.lit(0)).cast("string").alias("replication_clients"),
        F.coalesce("_status", F.lit("")).alias("wal_receiver_status"),
    ).unpivot(keys, ["is_in_recovery", "replication_clients", "wal_receiver_status"], "metric", "value")


def replication_status(results: DataFrame, by: Sequence[str] = ("instance",)) -> DataFrame:
    """Answer of the first statement that worked.

    ``results(..., source, ok, payload, priority)`` has one row per tried statement. ``access_ok`` is
    true as soon as one worked, also with no rows (``payload`` NULL); ``source`` tells which one.
    """
    best = F.min_by(F.struct("source", "payload"), F.when(F.col("ok"), F.col("priority")))
    return (
        results.groupBy(*by)
        .agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("access_ok"), best.alias("_best"))
        .select(
            *by,
            "access_ok",
            F.when(F.col("access_ok"), F.col("_best.source")).alias("source"),
            F.when(F.col("access_ok"), F.col("_best.payload")).alias("payload"),
        )
    )


def row_to_pairs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every other column of a wide row as ``name, value`` text."""
    fields = [field for field in rows.schema.fields if field.name not in keys]
    text = rows.select(*keys, *[as_text(F.col(field.name), field.dataType).alias(field.name) for field in fields])
    return text.unpivot(list(keys), [field.name for field in fields], "name", "value")
