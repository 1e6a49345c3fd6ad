"""Typed column values as snapshot text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_or_empty(pairs: Column, name: str) -> Column:
    """Value of ``name`` in a MAP<STRING,STRING>, '' where it is missing."""
    return F.coalesce(F.try_element_at(pairs, F.lit(name)), F.lit(""))


def _plain_double(value: Column) -> Column:
    """Shortest decimal text of a double without exponent and without a trailing ``.0``."""
    text = value.cast("string")
    plain = F.regexp_replace(text, r"\.0\z", "")
    mantissa = F.regexp_extract(text, r"\A-?([0-9.]+)", 1)
    whole = F.substring_index(mantissa, ".", 1)
    fraction = F.when(mantissa.contains("."), F.regexp_replace(F.substring_index(mantissa, ".", -1), r"0+\z", "")).otherwise("")
    digits = F.concat(whole, fraction)
    exponent = F.regexp_extract(text, r"E(-?\d+)\z", 1).cast("int")
    point = F.length(whole) + exponent
    size = F.length(digits)
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat_ws(".", F.left(digits, point), F.substr(digits, point + 1)))
    )
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise("")
    # Only text with an exponent needs its digits moved.
    return (
        F.when(text.contains("E"), F.concat(sign, body))
        .when(text.contains("Inf"), F.replace(text, F.lit("Infinity"), F.lit("inf")))
        .otherwise(plain)
    )


def _interval_text(value: Column) -> Column:
    """A day-time interval as ``[-]D HH:MM:SS.ffffff``."""
    value = value.cast("interval day to second")
    micros = F.abs(
        F.extract(F.lit("DAY"), value).cast("bigint") * 86_400_000_000
        + F.extract(F.lit("HOUR"), value).cast("bigint") * 3_600_000_000
        + F.extract(F.lit("MINUTE"), value).cast("bigint") * 60_000_000
        + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    )
    seconds = F.floor(micros / 1_000_000)
    sign = F.when(F.extract(F.lit("DAY"), value) < 0, "-").when(F.extract(F.lit("HOUR"), value) < 0, "-")
    sign = sign.when(F.extract(F.lit("MINUTE"), value) < 0, "-").when(F.extract(F.lit("SECOND"), value) < 0, "-")
    return F.concat(
        sign.otherwise(""),
        F.format_string(
            "%d %02d:%02d:%02d.%06d",
            F.floor(seconds / 86_400),
            F.floor(seconds / 3_600) % 24,
            F.floor(seconds / 60) % 60,
            seconds % 60,
            micros % 1_000_000,
        ),
    )


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Snapshot text of one typed value; NULL becomes the word ``NULL``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _plain_double(value)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(dtype, T.DayTimeIntervalType):
        text = _interval_text(value)
    elif isinstance(dtype, T.BinaryType):
        text = F.make_valid_utf8(value.cast("string"))
    elif isinstance(dtype, T.BooleanType):
        text = value.cast("int").cast("string")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("NULL")).otherwise(text)
