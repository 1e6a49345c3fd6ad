"""Joins on group keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the key columns are those of ``left``."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys], F.lit(True))
    return left.join(renamed, same, how).drop(*[f"_right_{key}" for key in keys])
