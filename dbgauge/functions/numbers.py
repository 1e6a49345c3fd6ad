"""Strict number parsing for log text.

``try_cast`` alone is too lax (it accepts ``1.5d`` or blanks), so a grammar check comes first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOUBLE = r"\A[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\z"
_UNSIGNED = r"\A\+?\d+\z"


def parse_double(text: Column) -> Column:
    return F.when(text.rlike(_DOUBLE), text.try_cast("double"))


def parse_unsigned(text: Column) -> Column:
    """Unsigned integer text as BIGINT; anything else, also 2^63 and above, is NULL."""
    return F.when(text.rlike(_UNSIGNED), text.try_cast("bigint"))


def unsigned_or_zero(text: Column) -> Column:
    return F.coalesce(parse_unsigned(text), F.lit(0).cast("bigint"))
