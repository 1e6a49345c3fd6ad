"""Queries over catalog, status and host snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.functions.values import text_or_empty
from dbgauge.operators.catalog import indexes_mysql, indexes_pg, table_sizes_mysql, table_sizes_pg
from dbgauge.operators.hostmetrics import command_samples, parse_os_samples
from dbgauge.operators.status import (
    lookup,
    pairs_to_map,
    pg_replication_status,
    pg_status_rollup,
    replication_status,
    row_to_pairs,
)
from dbgauge.plans.inputs import spread, table

BY_LIMIT = 20
# The lineitem expression that stands for each counter.
_COUNTER_INPUTS = [
    ("numbackends", "l_linenumber"),
    ("xact_commit", "l_orderkey"),
    ("xact_rollback", "l_partkey"),
    ("blks_read", "l_suppkey"),
    ("blks_hit", "CAST(l_quantity AS BIGINT)"),
    ("tup_returned", "CAST(floor(l_extendedprice) AS BIGINT)"),
    ("tup_fetched", "CAST(round(l_discount * 100) AS BIGINT)"),
    ("tup_inserted", "CAST(round(l_tax * 100) AS BIGINT)"),
    ("tup_updated", "CASE WHEN l_returnflag = 'R' THEN l_orderkey END"),
    ("tup_deleted", "CASE WHEN l_linestatus = 'none' THEN l_orderkey END"),
    ("deadlocks", "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END"),
]


def _mysql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables; two brands are system schemas; numbers arrive as text, some NULL."""
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("db"), (F.col("p_partkey") % 7).cast("string")).alias("instance"),
        F.when(brand == "Brand#1", "mysql").when(brand == "Brand#2", "sys").otherwise(brand).alias("table_schema"),
        F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 100).cast("string")).alias("table_name"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("engine"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).otherwise("NULL").alias("table_rows"),
        F.floor("p_retailprice").cast("string").alias("data_length"),
        F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") * 10).cast("string")).alias("index_length"),
    )


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sizes_mysql(_mysql_tables(spark, sf_dir)).drop("rank")


def table_sizes_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table_sizes_mysql(_mysql_tables(spark, sf_dir), BY_LIMIT, ["instance"])
    return sizes.withColumn("rank", F.col("rank").cast("bigint"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("db"), (key % 7).cast("string")).alias("instance"),
        F.when(brand == "Brand#1", "performance_schema").otherwise(brand).alias("table_schema"),
        F.col("p_type").alias("table_name"),
        F.col("p_name").alias("index_name"),
        (key % 2).cast("string").alias("non_unique"),
        (key + 1).cast("string").alias("seq_in_index"),
        F.concat(F.lit("c"), key.cast("string")).alias("column_name"),
        F.when(key % 3 != 0, F.col("p_size").cast("string")).alias("cardinality"),
    )


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes_mysql(_statistics(spark, sf_dir)).drop("rank")


def indexes_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexes_mysql(_statistics(spark, sf_dir), BY_LIMIT, ["instance"])
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


def _pg_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    relations = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("relnamespace"),
        F.col("c_name").alias("relname"),
        F.when(F.col("c_mktsegment") == "BUILDING", "i").otherwise("r").alias("relkind"),
        F.when(key % 10 == 0, -1.0).otherwise(F.floor(F.col("c_acctbal")).cast("double")).alias("reltuples"),
        (key * 8192).alias("data_length"),
        F.when(key % 3 != 0, key * 100).alias("index_length"),
        ((key * 37) % 1009).alias("total_length"),
    )
    nation = F.col("n_nationkey")
    namespaces = table(spark, sf_dir, "nation").select(
        nation.alias("oid"),
        F.when(nation == 0, "pg_catalog").when(nation == 1, "information_schema").otherwise(F.col("n_name")).alias("nspname"),
    )
    return relations, namespaces


def table_sizes_postgres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sizes_pg(*_pg_catalog(spark, sf_dir)).drop("rank")


def indexes_postgres(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_nationkey") == 3, "pg_catalog").otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("schemaname"),
        F.concat(F.lit("t"), (key % 10).cast("string")).alias("tablename"),
        F.col("s_name").alias("indexname"),
        F.concat(F.lit("CREATE INDEX ON t ("), "s_name", F.lit(")")).alias("indexdef"),
    )
    return indexes_pg(rows).drop("rank")


FLEET = 3


def _fleet_pg_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same oids in every instance, under other names; which oid is a system schema differs too. One instance has no name."""
    relations, namespaces = _pg_catalog(spark, sf_dir)
    instance = lambda n: F.when(n != 0, F.concat(F.lit("pg"), n.cast("string")))
    number = (F.col("data_length") / 8192).cast("bigint") % FLEET
    copies = namespaces.select("oid", F.explode(F.sequence(F.lit(0), F.lit(FLEET - 1))).alias("n"))
    named = copies.join(table(spark, sf_dir, "nation"), F.col("oid") == F.col("n_nationkey")).select(
        instance(F.col("n")).alias("instance"),
        "oid",
        F.when(F.col("oid") == F.col("n"), "pg_catalog").otherwise(F.concat("n_name", F.lit("-"), F.col("n").cast("string"))).alias("nspname"),
    )
    return relations.withColumn("instance", instance(number)), named


def table_sizes_postgres_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table_sizes_pg(*_fleet_pg_catalog(spark, sf_dir), BY_LIMIT, ["instance"])
    return sizes.withColumn("rank", F.col("rank").cast("bigint"))


def indexes_postgres_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index inventory of a fleet, without a limit."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.when(key % FLEET != 0, F.concat(F.lit("pg"), (key % FLEET).cast("string"))).alias("instance"),
        F.when(key % 11 == 0, "information_schema").otherwise(F.col("p_brand")).alias("schemaname"),
        F.concat(F.lit("t"), (key % 10).cast("string")).alias("tablename"),
        F.concat("p_name", F.lit("-"), key.cast("string")).alias("indexname"),
        F.concat(F.lit("CREATE INDEX ON t ("), "p_type", F.lit(")")).alias("indexdef"),
    )
    return indexes_pg(rows, None, ["instance"])


def _pg_stat_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        F.concat(F.lit("db"), (F.col("l_suppkey") % 10).cast("string")).alias("instance"),
        *[F.expr(text).alias(name) for name, text in _COUNTER_INPUTS],
    )


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg_status_rollup(_pg_stat_database(spark, sf_dir), ["instance"])


def status_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg_status_rollup(_pg_stat_database(spark, sf_dir))


def _pg_replication_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    recovery = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("instance"), (F.col("c_custkey") % 3 == 0).alias("in_recovery")
    )
    clients = orders.filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("instance"))
    receivers = orders.filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("status")
    )
    return recovery, clients, receivers


def pg_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg_replication_status(*_pg_replication_inputs(spark, sf_dir))


def replica_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer tried two statements; either, both or none worked."""
    key = F.col("c_custkey")
    payload = F.when(key % 5 != 0, F.col("c_mktsegment"))
    tried = F.array(
        F.struct(F.lit("SHOW REPLICA STATUS").alias("source"), (key % 3 == 0).alias("ok"), payload.alias("payload"), F.lit(1).alias("priority")),
        F.struct(F.lit("SHOW SLAVE STATUS").alias("source"), (key % 3 != 2).alias("ok"), F.lower(payload).alias("payload"), F.lit(2).alias("priority")),
    )
    results = table(spark, sf_dir, "customer").select(key.alias("instance"), F.inline(tried))
    return replication_status(results)


def _event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instance"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.col("props").alias("value")
    )


def latest_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map is unfolded again: maps compare badly."""
    maps = pairs_to_map(_event_pairs(spark, sf_dir))
    return maps.select("instance", F.explode("pairs").alias("name", "value"))


def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by name out of each instance's map; a missing one is the empty text."""
    maps = pairs_to_map(_event_pairs(spark, sf_dir))
    return maps.select("instance", *[text_or_empty(F.col("pairs"), name).alias(name) for name in ("click", "error", "no_such_name")])


def settings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(_event_pairs(spark, sf_dir), ["click", "view"])


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    missing = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    price = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice")).alias("o_totalprice")
    return row_to_pairs(orders.select("o_orderkey", "o_custkey", "o_orderstatus", price, "o_orderdate", missing), ["o_orderkey"])


def os_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as /proc snapshots; some lack the cpu word, the available memory or a load word."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    cpu = F.concat(
        F.when(key % 5 == 0, "intr").otherwise("cpu"), F.lit("  "), text, F.lit(" 2 "), cents, F.lit(" 4"),
        F.when(key % 3 == 0, "").otherwise(" 5 6 7 8"), F.lit("\ncpu0 1 1 1 1\n"),
    )
    mem = F.concat(
        F.lit("MemTotal:       "), cents, F.lit(" kB\nBuffers: 12 kB\n"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("MemAvailable:   "), text, F.lit(" kB\n"))),
        F.when(key % 2 == 0, F.concat(F.lit("SwapTotal: "), text, F.lit(" kB\nSwapFree:\t9 kB"))).otherwise(""),
    )
    load = F.concat(F.lit("0.10 "), F.col("o_totalprice").cast("string"), F.when(key % 11 == 0, " x").otherwise(" 0.5"), F.lit(" 2/"), text, F.lit(" "), text, F.lit("\n"))
    contents = F.array(*[
        F.struct(F.lit(path).alias("path"), content.alias("content"))
        for path, content in (("/proc/stat", cpu), ("/proc/meminfo", mem), ("/proc/loadavg", load))
    ])
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    samples = orders.select(F.col("o_custkey").alias("instance"), key.alias("ts"), F.inline(contents))
    return parse_os_samples(samples).select(
        "instance",
        "ts",
        F.col("proc_cpu.user").alias("cpu_user"),
        F.col("proc_cpu.system").alias("cpu_system"),
        F.col("proc_cpu.steal").alias("cpu_steal"),
        F.col("proc_mem.mem_total_kb").alias("mem_total_kb"),
        F.col("proc_mem.mem_available_kb").alias("mem_available_kb"),
        F.col("proc_mem.swap_total_kb").alias("swap_total_kb"),
        F.col("proc_mem.swap_free_kb").alias("swap_free_kb"),
        F.col("load_average.five").alias("load_five"),
        F.col("load_average.running_tasks").alias("running_tasks"),
        F.col("load_average.last_pid").alias("last_pid"),
    )


def command_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as command output."""
    key = F.col("doc_id")
    raw = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        F.lit("vmstat").alias("command"),
        (key % 5 != 0).alias("found"),
        (key % 3).cast("int").alias("status_code"),
        F.when(key % 13 == 0, " \n").otherwise(F.col("text")).alias("stdout"),
        F.when(key % 2 == 0, " \t").otherwise(F.concat(F.lit(" no "), F.col("lang"), F.lit("\n"))).alias("stderr"),
    )
    return command_samples(raw)


QUERIES = {
    "table_sizes": table_sizes,
    "table_sizes_by": table_sizes_by,
    "indexes": indexes,
    "indexes_by": indexes_by,
    "table_sizes_pg": table_sizes_postgres,
    "indexes_pg": indexes_postgres,
    "table_sizes_pg_by": table_sizes_postgres_by,
    "indexes_pg_by": indexes_postgres_by,
    "status_rollup": status_rollup,
    "status_total": status_total,
    "pg_replication_status": pg_replication,
    "replication_status": replica_status,
    "pairs_to_map": latest_settings,
    "status_texts": status_texts,
    "settings_lookup": settings_lookup,
    "row_to_pairs": wide_rows,
    "os_samples": os_samples,
    "command_samples": command_results,
}

_TABLES = """
WITH t AS (
  SELECT 'db' || (p_partkey % 7) AS instance, CASE p_brand WHEN 'Brand#1' THEN 'mysql' WHEN 'Brand#2' THEN 'sys' ELSE p_brand END AS table_schema,
    p_name || '-' || (p_partkey % 100) AS table_name, CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE '' END AS engine,
    CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS BIGINT) AS table_rows, CAST(floor(p_retailprice) AS BIGINT) AS data_length,
    CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_size * 10 ELSE 0 END AS BIGINT) AS index_length
  FROM part
), s AS (SELECT *, data_length + index_length AS total_length FROM t WHERE table_schema NOT IN ('information_schema', 'mysql', 'performance_schema', 'sys'))"""
_INDEXES = """
WITH s AS (
  SELECT 'db' || (p_partkey % 7) AS instance, p_brand AS table_schema, p_type AS table_name, p_name AS index_name, p_partkey % 2 AS non_unique,
    p_partkey + 1 AS seq_in_index, 'c' || p_partkey AS column_name, CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS BIGINT) AS cardinality
  FROM part WHERE p_brand <> 'Brand#1'
)"""
_SIZE_ORDER = "ORDER BY total_length DESC, table_schema, table_name"
_INDEX_ORDER = "ORDER BY table_schema, table_name, index_name, seq_in_index"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"


def _union_of_sums(instance: str, group: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {instance} '{name}' AS metric, CAST(CAST(coalesce(sum({text}), 0) AS BIGINT) AS VARCHAR) AS value FROM lineitem {group}"
        for name, text in _COUNTER_INPUTS
    )


ORACLES = {
    "table_sizes": _TABLES + f" SELECT * EXCLUDE (instance) FROM s {_SIZE_ORDER} LIMIT 200",
    "table_sizes_by": _TABLES
    + f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance {_SIZE_ORDER}) AS rank FROM s) WHERE rank <= {BY_LIMIT}",
    "indexes": _INDEXES + f" SELECT * EXCLUDE (instance) FROM s {_INDEX_ORDER} LIMIT 500",
    "indexes_by": _INDEXES
    + f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance {_INDEX_ORDER}) AS rank FROM s) WHERE rank <= {BY_LIMIT}",
    "table_sizes_pg": f"""
SELECT n_name AS table_schema, c_name AS table_name,
  CAST(CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE floor(c_acctbal) END AS BIGINT) AS estimated_rows, c_custkey * 8192 AS data_length,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 100 ELSE 0 END AS index_length, (c_custkey * 37) % 1009 AS total_length
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey > 1 AND c_mktsegment <> 'BUILDING' {_SIZE_ORDER} LIMIT 200""",
    "indexes_pg": """
SELECT 'n' || s_nationkey AS table_schema, 't' || (s_suppkey % 10) AS table_name, s_name AS index_name, 'CREATE INDEX ON t (' || s_name || ')' AS index_def
FROM supplier WHERE s_nationkey <> 3 ORDER BY 1, 2, 3 LIMIT 500""",
    "table_sizes_pg_by": f"""
WITH t AS (
  SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'pg' || (c_custkey % 3) END AS instance, n_name || '-' || (c_custkey % 3) AS table_schema, c_name AS table_name,
    CAST(CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE floor(c_acctbal) END AS BIGINT) AS estimated_rows, c_custkey * 8192 AS data_length,
    CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 100 ELSE 0 END AS index_length, (c_custkey * 37) % 1009 AS total_length
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> c_custkey % 3 AND c_mktsegment <> 'BUILDING'
) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance {_SIZE_ORDER}) AS rank FROM t) WHERE rank <= {BY_LIMIT}""",
    "indexes_pg_by": """
SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'pg' || (p_partkey % 3) END AS instance, p_brand AS table_schema, 't' || (p_partkey % 10) AS table_name,
  p_name || '-' || p_partkey AS index_name, 'CREATE INDEX ON t (' || p_type || ')' AS index_def FROM part WHERE p_partkey % 11 <> 0""",
    "status_rollup": _union_of_sums("'db' || (l_suppkey % 10) AS instance,", "GROUP BY 1"),
    "status_total": _union_of_sums("", ""),
    "pg_replication_status": """
SELECT c_custkey AS instance, 'is_in_recovery' AS metric, CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END AS value FROM customer
UNION ALL
SELECT c_custkey, 'replication_clients', CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS VARCHAR) FROM customer
UNION ALL
SELECT c_custkey, 'wal_receiver_status', coalesce((SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), '') FROM customer""",
    "replication_status": """
SELECT c_custkey AS instance, c_custkey % 3 <> 2 AS access_ok,
  CASE c_custkey % 3 WHEN 0 THEN 'SHOW REPLICA STATUS' WHEN 1 THEN 'SHOW SLAVE STATUS' END AS source,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) END END AS payload
FROM customer""",
    "pairs_to_map": "SELECT user_id AS instance, event_type AS name, arg_max(props, event_id) AS value FROM events GROUP BY 1, 2",
    "status_texts": """
SELECT user_id AS instance, coalesce(arg_max(props, event_id) FILTER (WHERE event_type = 'click'), '') AS click,
  coalesce(arg_max(props, event_id) FILTER (WHERE event_type = 'error'), '') AS error, '' AS no_such_name FROM events GROUP BY 1""",
    "settings_lookup": """
SELECT user_id AS instance, arg_max(props, event_id) FILTER (WHERE event_type = 'click') AS click,
  arg_max(props, event_id) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""",
    "row_to_pairs": r"""
SELECT o_orderkey, 'o_custkey' AS name, CAST(o_custkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 'o_totalprice', regexp_replace(CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS VARCHAR), '\.0$', '') FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE 'NULL' END FROM orders""",
    "os_samples": """
WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_custkey AS instance, o_orderkey AS ts,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS cpu_user, CASE WHEN o_orderkey % 5 <> 0 THEN cents END AS cpu_system,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 8 END::BIGINT END AS cpu_steal,
  CASE WHEN o_orderkey % 7 <> 0 THEN cents END AS mem_total_kb, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS mem_available_kb,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END END AS swap_total_kb,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 0 END::BIGINT END AS swap_free_kb,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS load_five,
  CASE WHEN o_orderkey % 11 <> 0 THEN '2/' || o_orderkey END AS running_tasks, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS last_pid
FROM o""",
    "command_samples": f"""
WITH r AS (
  SELECT doc_id, doc_id % 5 <> 0 AS available, CAST(doc_id % 3 AS INTEGER) AS code,
    CASE WHEN doc_id % 13 <> 0 THEN {_STRIP.format('text')} END AS body, CASE WHEN doc_id % 2 <> 0 THEN 'no ' || lang END AS complaint
  FROM documents
), e AS (
  SELECT *, CASE WHEN NOT available THEN 'command not found' WHEN code <> 0 THEN coalesce(complaint, 'exit status: exit status: ' || code) END AS error FROM r
)
SELECT doc_id, 'vmstat' AS command, available, CASE WHEN available THEN code END AS status_code,
  CASE WHEN available THEN CASE WHEN length(body) > 4000 THEN left(body, 4000) || chr(10) || '...[truncated]' ELSE nullif(body, '') END END AS output,
  error, CASE WHEN available AND error IS NOT NULL THEN 'vmstat failed: ' || error END AS warning
FROM e""",
}
