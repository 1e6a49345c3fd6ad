"""Table-size and index inventories over landed catalog snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbgauge.functions.numbers import unsigned_or_zero
from dbgauge.operators.joins import join_groups
from dbgauge.operators.ranking import top_per_group

# Schemas of the server itself, and the row limits.
MYSQL_SYSTEM_SCHEMAS = ["information_schema", "mysql", "performance_schema", "sys"]
PG_SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
TABLE_LIMIT = 200
INDEX_LIMIT = 500


def _number(name: str) -> Column:
    """Catalog number as BIGINT; NULL or other text is 0."""
    return F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))


def _unsigned(name: str) -> Column:
    """Strict: signs other than ``+``, blanks and fractions are 0."""
    return unsigned_or_zero(F.col(name).cast("string"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _user_tables(rows: DataFrame, schema: str, system: Sequence[str]) -> DataFrame:
    return rows.filter(F.col(schema).isNotNull() & ~F.col(schema).isin(list(system)))


def _listed(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int | None, spread_on: Sequence[str]) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``; with None all rows, sorted by group and order, without ranks."""
    if limit is None:
        return rows.orderBy(*by, *order)
    return top_per_group(rows, by, order, limit, spread_on=spread_on)


def table_sizes_mysql(tables: DataFrame, limit: int | None = TABLE_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Largest tables by data plus index length; ties by schema and table name."""
    sizes = _user_tables(tables, "table_schema", MYSQL_SYSTEM_SCHEMAS).select(
        *by,
        "table_schema",
        _text("table_name").alias("table_name"),
        _text("engine").alias("engine"),
        _unsigned("table_rows").alias("table_rows"),
        _unsigned("data_length").alias("data_length"),
        _unsigned("index_length").alias("index_length"),
        (_unsigned("data_length") + _unsigned("index_length")).alias("total_length"),
    )
    order = [F.col("total_length").desc(), F.col("table_schema"), F.col("table_name")]
    return _listed(sizes, by, order, limit, spread_on=["table_schema", "table_name"] if by else ())


def indexes_mysql(statistics: DataFrame, limit: int | None = INDEX_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Index columns in order of schema, table, index and position in the index."""
    rows = _user_tables(statistics, "table_schema", MYSQL_SYSTEM_SCHEMAS).select(
        *by,
        "table_schema",
        _text("table_name").alias("table_name"),
        _text("index_name").alias("index_name"),
        _unsigned("non_unique").alias("non_unique"),
        _unsigned("seq_in_index").alias("seq_in_index"),
        _text("column_name").alias("column_name"),
        _unsigned("cardinality").alias("cardinality"),
    )
    names = ["table_schema", "table_name", "index_name"]
    order = [*[F.col(name) for name in names], F.col("seq_in_index"), F.col("column_name")]
    return _listed(rows, by, order, limit, spread_on=names if by else ())


def table_sizes_pg(
    pg_class: DataFrame, pg_namespace: DataFrame, limit: int | None = TABLE_LIMIT, by: Sequence[str] = ()
) -> DataFrame:
    """Largest ordinary tables by total relation size; ties by schema and table name.

    The namespace side carries a few rows per instance; Spark broadcasts it where its size allows.
    """
    namespaces = _user_tables(pg_namespace, "nspname", PG_SYSTEM_SCHEMAS).select(
        *by, F.col("oid").alias("relnamespace"), F.col("nspname").alias("table_schema")
    )
    ordinary = pg_class.filter((F.col("relkind") == "r") & F.col("relnamespace").isNotNull())
    sizes = (
        join_groups(ordinary, namespaces, [*by, "relnamespace"])
        .select(
            *by,
            "table_schema",
            F.col("relname").alias("table_name"),
            F.coalesce(F.round("reltuples").try_cast("bigint"), F.lit(0).cast("bigint")).alias("estimated_rows"),
            _number("data_length").alias("data_length"),
            _number("index_length").alias("index_length"),
            _number("total_length").alias("total_length"),
        )
    )
    order = [F.col("total_length").desc(), F.col("table_schema"), F.col("table_name")]
    return _listed(sizes, by, order, limit, spread_on=["table_schema", "table_name"] if by else ())


def indexes_pg(pg_indexes: DataFrame, limit: int | None = INDEX_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Index definitions in order of schema, table and index name."""
    rows = _user_tables(pg_indexes, "schemaname", PG_SYSTEM_SCHEMAS).select(
        *by,
        F.col("schemaname").alias("table_schema"),
        F.col("tablename").alias("table_name"),
        F.col("indexname").alias("index_name"),
        F.col("indexdef").alias("index_def"),
    )
    names = ["table_schema", "table_name", "index_name"]
    return _listed(rows, by, [F.col(name) for name in names], limit, spread_on=names if by else ())
