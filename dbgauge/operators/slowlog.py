"""Slow-query log parsing: MySQL records and PostgreSQL duration/statement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbgauge.functions.numbers import parse_double, unsigned_or_zero
from dbgauge.functions.text import NON_WS, WS, null_if_empty, strip_ws
from dbgauge.schemas import POSITION
from dbgauge.sources.logs import RECORD_MARK

# White space that does not end a line.
_BLANK = rf"[{WS}&&[^\n]]"

# The names of the metrics, and the lines of a record that are not part of its SQL.
_METRIC_MARK = "Query_time:"
_SKIPPED_LINE = rf"(?dm)^(?:[^\n]*Query_time:[^\n]*|{_BLANK}*+(?:#|SET timestamp=)[^\n]*|{_BLANK}*+)(?:\n|\z)"
_LINE_EDGES = rf"(?dm)^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$"
# A line behind the header that belongs to the SQL; without one the record has no SQL.
_SQL_LINE = rf"\n(?![^\n]*Query_time:|{_BLANK}*+(?:#|SET timestamp=|\n|\z))"
_OLD_TIME = "yyMMdd H:mm:ss"
_LINE_TIME = r"\A(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?: ?(?:Z|UTC|[+-]\d{2}:?\d{2}))?)"


def _metric(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf"{name}:{WS}*+({NON_WS}++)", 1)


def _last_metric_line(body: Column) -> Column:
    """The last line that holds the metric mark, '' without one."""
    behind = F.substring_index(body, _METRIC_MARK, -1)
    before = F.left(body, F.length(body) - F.length(behind) - len(_METRIC_MARK))
    line = F.concat(F.substring_index(before, "\n", -1), F.lit(_METRIC_MARK), F.substring_index(behind, "\n", 1))
    return F.when(body.contains(_METRIC_MARK), line).otherwise("")


def _event_time(header: Column) -> Column:
    """ISO time, or the ``yymmdd h:mm:ss`` form of old servers; NULL where there is neither."""
    text = F.regexp_replace(strip_ws(header), " +", " ")
    iso = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d"), text.try_cast("timestamp"))
    old = F.when(text.rlike(r"\A\d{6} \d"), F.try_to_timestamp(text, F.lit(_OLD_TIME)))
    return F.coalesce(iso, old)


def parse_mysql_slow_log(records: DataFrame, record: str = "record") -> DataFrame:
    """``# Time:`` records to entries; columns other than ``record`` are kept.

    The last line with ``Query_time:`` sets all four metrics (missing or bad ones are 0). Comment,
    ``SET timestamp=`` and blank lines are left out of the SQL; a record without SQL gives no row.
    It is a projection and a filter, so it runs on a stream as well.
    """
    kept = [name for name in records.columns if name != record]
    text = F.col(record)
    # Tested on the raw text: a filter on the parsed SQL would be pushed down and parse everything twice.
    cut = records.filter(text.rlike(_SQL_LINE)).select(
        *kept,
        F.regexp_extract(text, rf"\A(?:{RECORD_MARK})?([^\n]*)", 1).alias("_header"),
        F.substr(text, F.instr(text, "\n") + 1).alias("_body"),
    )
    sql = F.regexp_replace(F.regexp_replace("_body", _SKIPPED_LINE, ""), _LINE_EDGES, "")
    parsed = cut.select(
        *kept,
        _event_time(F.col("_header")).alias("ts"),
        strip_ws(sql).alias("sql"),
        _last_metric_line(F.col("_body")).alias("_metrics"),
    )
    names = ["Query_time", "Lock_time", "Rows_sent", "Rows_examined"]
    worded = parsed.select(*kept, "ts", "sql", *[_metric(F.col("_metrics"), name).alias(name) for name in names])
    return worded.select(
        *kept,
        "ts",
        "sql",
        F.coalesce(parse_double(F.col("Query_time")), F.lit(0.0)).alias("query_time_secs"),
        F.coalesce(parse_double(F.col("Lock_time")), F.lit(0.0)).alias("lock_time_secs"),
        unsigned_or_zero(F.col("Rows_sent")).alias("rows_sent"),
        unsigned_or_zero(F.col("Rows_examined")).alias("rows_examined"),
    )


def pg_duration_secs(line: Column) -> Column:
    """Seconds behind the first ``duration:`` of a line, NULL where there is no number.

    Units: ``s``/``sec``/``secs``, ``us``; every other word, or none, counts as milliseconds.
    """
    pattern = rf"(?i)duration:{WS}*+({NON_WS}++)(?:{WS}++({NON_WS}++))?"
    value = parse_double(F.rtrim(F.regexp_extract(line, pattern, 1), F.lit(",")))
    unit = F.rtrim(F.regexp_extract(line, pattern, 2), F.lit(","))
    return F.when(unit.isin("s", "sec", "secs"), value).when(unit == "us", value / 1_000_000).otherwise(value / 1_000)


def pg_statement_sql(line: Column) -> Column:
    """SQL behind the first ``statement:``, else behind ``execute <name>:``; NULL where there is none."""
    statement = strip_ws(F.regexp_extract(line, r"(?is)statement:(.*)\z", 1))
    execute = strip_ws(F.regexp_extract(line, r"(?is)execute [^:]*+:(.*)\z", 1))
    return F.coalesce(null_if_empty(statement), null_if_empty(execute))


def log_line_time(line: Column) -> Column:
    """Time at the head of a log line: ISO with ``T``/``Z`` or ``yyyy-MM-dd HH:mm:ss[.SSS] UTC``."""
    head = F.regexp_extract(line, _LINE_TIME, 1)
    return F.when(head != "", head.try_cast("timestamp"))


def _entry(secs: Column) -> list[Column]:
    return [
        *[F.col(name) for name in POSITION],
        "ts",
        "sql",
        secs.alias("query_time_secs"),
        F.lit(0.0).alias("lock_time_secs"),
        F.lit(0).cast("bigint").alias("rows_sent"),
        F.lit(0).cast("bigint").alias("rows_examined"),
    ]


def _lent() -> Column:
    """The duration that a line lends to the next one, as a struct, so that no line before differs from one that lends nothing."""
    return F.struct(F.when(F.col("sql").isNull(), F.col("secs")).alias("secs"))


def _placed(lines: DataFrame) -> DataFrame:
    """Durations and SQL of the lines that are not blank, with what the line before in the block lends and whether one follows."""
    text = strip_ws(F.col("line"))
    parsed = (
        lines.select(*POSITION, text.alias("line"))
        .filter(F.col("line") != "")
        .select(
            *POSITION,
            log_line_time(F.col("line")).alias("ts"),
            pg_duration_secs(F.col("line")).alias("secs"),
            pg_statement_sql(F.col("line")).alias("sql"),
        )
    )
    in_block = Window.partitionBy("source", "block").orderBy("mid")
    return parsed.select("*", F.lag(_lent()).over(in_block).alias("before"), F.lead(F.lit(True)).over(in_block).alias("after"))


def log_series(source: Column) -> Column:
    """The log that a file is a chunk of: its path without a trailing number (``.1``), or without the digits of a date or counter in its name."""
    name = F.regexp_extract(source, r"([^/]*)\z", 1)
    return F.concat(F.left(source, F.length(source) - F.length(name)), F.regexp_replace(F.regexp_replace(name, r"\.[0-9]+\z", ""), r"[-_.]?[0-9]+", ""))


def chunk_order(source: Column) -> Column:
    """Sorts the chunks of a series by age: files renamed to ``.2``, ``.1`` before the one being written; others by name."""
    return F.struct(-F.coalesce(F.regexp_extract(source, r"\.([0-9]+)\z", 1).try_cast("int"), F.lit(0)), source)


def pair_across_chunks(
    lines: DataFrame, carried: DataFrame, series: Column | None = None, order: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entries of chunks of logs, and what their last lines lend to the next chunk: (series, secs).

    ``carried`` is what the chunks before have lent. As ``parse_pg_statement_log``, but the line before may be in another file of the ``series``, or of
    an earlier call. Inside a block a line looks back one line; only edge lines, two per block, meet along a series, and one row per series is carried. A
    series without lines keeps what it has.
    """
    series = log_series(F.col("source")) if series is None else series
    order = chunk_order(F.col("source")) if order is None else order
    placed = _placed(lines)
    inner = placed.filter(F.col("before").isNotNull()).select("*", F.col("before.secs").alias("borrowed"))
    along = Window.partitionBy("series").orderBy(order, "block", "mid")
    edges = placed.filter(F.col("before").isNull() | F.col("after").isNull()).withColumn("series", series)
    linked = edges.withColumn("ahead", F.lag(_lent()).over(along))
    heads = linked.filter(F.col("before").isNull())
    met = heads.join(carried.select("series", F.col("secs").alias("_carried")), "series", "left")
    borrowed = F.when(F.col("ahead").isNull(), F.col("_carried")).otherwise(F.col("ahead.secs"))
    first = met.select(*placed.columns, borrowed.alias("borrowed"))
    secs = F.coalesce("secs", "borrowed")
    entries = inner.unionByName(first).filter(F.col("sql").isNotNull() & secs.isNotNull()).select(*_entry(secs))
    last = edges.groupBy("series").agg(F.max_by(_lent(), F.struct(order, "block", "mid"))["secs"].alias("secs"))
    kept = carried.select("series", "secs").join(last.select("series"), "series", "left_anti")
    return entries, last.filter(F.col("secs").isNotNull()).unionByName(kept)


def parse_pg_statement_log(lines: DataFrame) -> DataFrame:
    """PostgreSQL log lines to entries.

    A line with duration and SQL is an entry. A line with a duration alone lends it to the next
    non-blank line, which is an entry if it holds SQL but no duration. So one line looks back one line:
    ``lag`` within each (source, block). The first line of a block looks back at the last line of the
    block before; those edge lines (two per block) go through a second ``lag`` per source. The shuffle
    carries duration and SQL, not the raw lines, and both branches read the same one.
    """
    lent = _lent()
    placed = _placed(lines)
    in_source = Window.partitionBy("source").orderBy("block", "mid")
    inner = placed.filter(F.col("before").isNotNull()).select("*", F.col("before.secs").alias("borrowed"))
    edges = (
        placed.filter(F.col("before").isNull() | F.col("after").isNull())
        .withColumn("borrowed", F.lag(lent).over(in_source)["secs"])
        .filter(F.col("before").isNull())
    )
    secs = F.coalesce("secs", "borrowed")
    return inner.unionByName(edges).filter(F.col("sql").isNotNull() & secs.isNotNull()).select(*_entry(secs))
