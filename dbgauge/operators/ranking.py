"""Top-n per group that stays spread out when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 32


def top_per_group(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", spread_on: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, numbered from 1 in column ``rank``.

    With ``spread_on`` a group is first ranked in SPREAD parts (by the hash of those columns), which
    keeps at most ``n`` rows per part; the ranking over the parts is exact. In both steps Spark cuts
    the groups to ``n`` before the shuffle too (WindowGroupLimit).
    """
    if spread_on:
        part = F.pmod(F.xxhash64(*spread_on), F.lit(SPREAD)).alias("_part")
        rows = rows.select("*", part)
        first = Window.partitionBy(*by, "_part").orderBy(*order)
        rows = rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n).drop("_rank", "_part")
    if not by:
        # One global list: TakeOrderedAndProject cuts every partition first, then numbers n rows.
        top = rows.orderBy(*order).limit(n).withColumn("_all", F.lit(0))
        return top.withColumn(rank, F.row_number().over(Window.partitionBy("_all").orderBy(*order))).drop("_all")
    last = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= n)
