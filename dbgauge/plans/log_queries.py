"""Queries over logs: digests, pairing, alerts, segments, file scans and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.functions.sqltext import fingerprint
from dbgauge.operators.alerts import alerts
from dbgauge.operators.digest import digest, digest_parts, merge_digest_parts, rank_digests
from dbgauge.operators.segments import appended_since, tail_lines
from dbgauge.operators.slowlog import parse_mysql_slow_log, parse_pg_statement_log
from dbgauge.operators.snapshots import error_log_snapshot, slow_log_snapshot
from dbgauge.plans.inputs import (
    document_lines,
    error_lines,
    instance_error_lines,
    land_document_files,
    pg_lines,
    slow_records,
    spread,
    table,
)
from dbgauge.session import scratch_path
from dbgauge.sources.files import latest_files, list_files, resolve_log_paths
from dbgauge.sources.logs import read_log_lines, read_slow_log_records
from dbgauge.sources.ranges import log_files, read_appended, read_tail

DOC_RULES = {"license": ["license", "copyright"], "contact": ["@", "phone"], "question": ["?"]}
MANY_RULES = {
    **{f"code_{group}": [f"err-{group}{number:02d}" for number in range(18)] for group in "abcdefghijk"},
    "license": ["license", "licence"],
    "question": ["?"],
}
TAIL_LINES = 5
TAIL_BYTES = 300
SEGMENT_BYTES = 2_000


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_mysql_slow_log(slow_records(table(spark, sf_dir, "events")))


def slow_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_digests(digest(_entries(spark, sf_dir), position=["mid"]))


def slow_digest_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["instance"]
    return rank_digests(digest(_entries(spark, sf_dir), by, position=["mid"]), by)


def slow_digest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["instance"]
    return rank_digests(digest(_entries(spark, sf_dir), by), by, top_n=2).select(
        "instance", F.col("rank").cast("bigint").alias("rank"), "fingerprint", "count", "total_query_time_secs"
    )


def slow_record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as slow-log files and read back with the record-delimited scan."""
    path = scratch_path(spark, "slow-log")
    slow_records(table(spark, sf_dir, "events")).select(F.concat(F.lit("# Time:"), F.col("record")).alias("value")).write.text(path)
    entries = parse_mysql_slow_log(read_slow_log_records(spark, path))
    return digest(entries).select(
        "fingerprint", "count", "total_query_time_secs", "total_lock_time_secs", "total_rows_sent", "total_rows_examined"
    )


def pg_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_pg_statement_log(pg_lines(table(spark, sf_dir, "events")))
    return entries.select("source", F.floor(F.col("mid") / 4).alias("event_id"), "sql", "query_time_secs", "rows_sent")


def pg_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_pg_statement_log(pg_lines(table(spark, sf_dir, "events")))
    return rank_digests(digest(entries, position=["mid"]))


def fingerprint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts(error_lines(table(spark, sf_dir, "events")))
    return found.select("category", "count", F.array_join("sample_lines", "|").alias("sample_lines"))


def alerts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts(instance_error_lines(table(spark, sf_dir, "events")), by=["instance"])
    return found.select("instance", "category", "count", F.array_join("sample_lines", "|").alias("sample_lines"))


def alerts_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts(document_lines(table(spark, sf_dir, "documents")), by=["source"], rules=DOC_RULES)
    return found.select("source", "category", "count", F.array_join("sample_lines", "|").alias("sample_lines"))


def alerts_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred phrases, most of which no line has: words behind a mark, and two that occur."""
    found = alerts(document_lines(table(spark, sf_dir, "documents")), by=["source"], rules=MANY_RULES)
    return found.select("source", "category", "count", F.array_join("sample_lines", "|").alias("sample_lines"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest parts kept by day."""
    path = scratch_path(spark, "digest-days")
    entries = _entries(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    digest_parts(entries, ["day"], position=["mid"]).write.partitionBy("day").parquet(path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


def digest_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all logs from what was kept of each day."""
    return rank_digests(merge_digest_parts(_days(spark, sf_dir)))


def digest_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of each month from what was kept of its days: no log is parsed again."""
    kept = _days(spark, sf_dir).withColumn("month", F.left("day", F.lit(7)))
    return merge_digest_parts(kept, ["month"]).drop("avg_query_time_secs")


def tail_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail_lines(document_lines(table(spark, sf_dir, "documents")), TAIL_LINES).select("source", F.col("back").cast("bigint").alias("back"), "line")


def tail_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = tail_lines(document_lines(table(spark, sf_dir, "documents")), TAIL_LINES, TAIL_BYTES)
    return tail.select("source", F.col("back").cast("bigint").alias("back"), "line")


def appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document has no checkpoint, every fifth one behind its end (a rotated file)."""
    documents = table(spark, sf_dir, "documents")
    offset = F.when(F.col("doc_id") % 5 == 0, F.octet_length("text") + 100).otherwise(F.floor(F.col("n_chars") / 2))
    known = documents.select(
        F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_id") % 7 != 0, offset).alias("offset")
    )
    return appended_since(document_lines(documents), known, SEGMENT_BYTES).select("source", "offset", "line")


def _file() -> Column:
    """Number of a landed file."""
    return F.regexp_extract("source", r"/file=(\d+)/", 1).cast("bigint")


def tail_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of landed files, of which only the ends are read."""
    path = scratch_path(spark, "tails")
    land_document_files(spark, sf_dir, path)
    return read_tail(spark, path, TAIL_LINES, TAIL_BYTES).select(_file().alias("file"), F.col("back").cast("bigint").alias("back"), "line")


def appended_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What landed files hold behind their checkpoints. Every seventh file has none, every fifth one behind its end."""
    path = scratch_path(spark, "appended")
    land_document_files(spark, sf_dir, path)
    offset = F.when(_file() % 5 == 0, F.col("file_size") + 100).otherwise(F.floor(F.col("file_size") / 2))
    known = log_files(spark, path).select("source", F.when(_file() % 7 != 0, offset).alias("offset"))
    return read_appended(spark, path, known, SEGMENT_BYTES).select(_file().alias("file"), "offset", "line")


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a file listing: the host is the folder, and few distinct times give ties."""
    listing = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("dir"), F.col("url").alias("path"), (F.col("page_id") % 3).alias("modification_time")
    )
    return latest_files(listing).select("dir", "path")


def log_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written per language, then listed with the metadata-only file scan."""
    path = scratch_path(spark, "listing")
    documents = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value"))
    documents.write.partitionBy("lang").text(path)
    files = list_files(spark, path).filter(F.col("path").endswith(".txt"))
    lang = F.regexp_extract("dir", "lang=([^/]+)", 1).alias("lang")
    newest = latest_files(files).select("dir", F.col("path").alias("newest"))
    return (
        files.join(newest, "dir")
        .groupBy(lang)
        .agg(F.sum("length").alias("bytes"), F.count_distinct("newest").alias("newest_files"))
    )


def log_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files per language and read back line by line."""
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    return (
        read_log_lines(spark, path)
        .groupBy(F.regexp_extract("source", "lang=([^/]+)", 1).alias("lang"))
        .agg(
            F.count("*").alias("lines"),
            F.sum("bytes").alias("bytes"),
            F.sum(F.length("line")).alias("chars"),
            F.count_if(F.col("line") == "").alias("empty_lines"),
        )
    )


def log_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances with settings, orders as the files in their log folders."""
    key = F.col("c_custkey")
    postgres = key % 2 == 1
    customers = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("instance"),
        F.when(postgres, "postgres").otherwise("mysql").alias("engine"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("/log/"), "c_name", F.lit("-slow.log"))).alias("slow_query_log_file"),
        F.when(key % 4 == 2, "stderr").otherwise(F.concat(F.lit("/log/"), "c_name", F.lit(".err"))).alias("log_error"),
        F.when(key % 6 == 1, "off").otherwise(" ON ").alias("logging_collector"),
        F.concat(F.lit("/pg/"), key.cast("string")).alias("data_directory"),
        F.when(key % 10 == 3, F.concat(F.lit("/abs/"), key.cast("string"))).otherwise("log").alias("log_directory"),
        F.when(key % 3 == 0, "server.log").otherwise("postgresql-%d.log").alias("log_filename"),
        F.when(key % 9 == 0, "/override/slow.log").when(key % 9 == 4, "  ").alias("slow_log_path"),
        F.when(key % 8 == 3, "/override/error.log").alias("error_log_path"),
    )
    names = ["slow_query_log_file", "log_error", "logging_collector", "data_directory", "log_directory", "log_filename"]
    settings = customers.unpivot(["instance", "engine"], names, "name", "value")
    owner = F.col("o_custkey")
    folder = F.when(owner % 10 == 3, F.concat(F.lit("/abs/"), owner.cast("string"))).otherwise(
        F.concat(F.lit("/pg/"), owner.cast("string"), F.lit("/log"))
    )
    name = F.when(F.col("o_orderstatus") == "F", "server.log").otherwise(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".log")))
    files = table(spark, sf_dir, "orders").select(
        owner.cast("string").alias("instance"),
        folder.alias("dir"),
        F.concat(folder, F.lit("/"), name).alias("path"),
        F.col("o_orderdate").alias("modification_time"),
    )
    overrides = customers.select("instance", "slow_log_path", "error_log_path")
    return resolve_log_paths(settings, files, overrides)


def slow_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = slow_records(table(spark, sf_dir, "events"))
    segment = records.select("instance", F.octet_length("record").cast("bigint").alias("bytes"))
    digests = digest(parse_mysql_slow_log(records), ["instance"], position=["mid"])
    shown = F.transform("digests", lambda d: F.concat_ws("=", d["fingerprint"], d["count"].cast("string")))
    return slow_log_snapshot(segment, digests, ["instance"]).select(
        "instance", "collected_bytes", "parsed_entries", "digest_count", F.array_join(shown, "|").alias("digests")
    )


def error_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = instance_error_lines(table(spark, sf_dir, "events"))
    shown = F.transform("alerts", lambda a: F.concat_ws("=", a["category"], a["count"].cast("string")))
    return error_log_snapshot(lines, alerts(lines, ["instance"]), ["instance"]).select(
        "instance", "sampled_lines", "alert_count", F.array_join(shown, "|").alias("alerts")
    )


QUERIES = {
    "slow_digest": slow_digest,
    "slow_digest_by": slow_digest_by,
    "slow_digest_top": slow_digest_top,
    "slow_record_scan": slow_record_scan,
    "pg_pairing": pg_pairing,
    "pg_digest": pg_digest,
    "fingerprint_text": fingerprint_text,
    "alerts": alerts_all,
    "alerts_by": alerts_by,
    "alerts_rules": alerts_rules,
    "alerts_many_rules": alerts_many_rules,
    "digest_of_days": digest_of_days,
    "digest_of_months": digest_of_months,
    "tail_lines": tail_by_lines,
    "tail_bytes": tail_by_bytes,
    "appended_since": appended_lines,
    "tail_of_files": tail_of_files,
    "appended_to_files": appended_to_files,
    "latest_files": newest_files,
    "log_file_listing": log_file_listing,
    "log_line_scan": log_line_scan,
    "log_paths": log_paths,
    "slow_log_snapshot": slow_snapshot,
    "error_log_snapshot": error_snapshot,
}

_SHAPE = "'select * from ' || event_type || ' where user_id = ? and name = ?;'"
_SQL = "'SELECT * FROM ' || event_type || ' WHERE user_id = ' || user_id || chr(10) || 'AND name = ''u' || user_id || ''';'"
_DIGEST_SUMS = """
    count(*) AS count,
    CAST(sum(CAST(value AS DECIMAL(20,9))) AS DOUBLE) AS total_query_time_secs,
    CAST(sum(CAST(value AS DECIMAL(20,9))) AS DOUBLE) / count(*) AS avg_query_time_secs,
    CAST(count(*) * CAST(0.001 AS DECIMAL(20,9)) AS DOUBLE) AS total_lock_time_secs,
    CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_rows_sent,
    CAST(sum(user_id) AS BIGINT) AS total_rows_examined"""
_RANK = "CAST(floor(total_query_time_secs * 1000000) AS BIGINT) DESC, count DESC, fingerprint"
_BY_INSTANCE = f"""
WITH d AS (
  SELECT 'db-' || (user_id % 10) AS instance, {_SHAPE} AS fingerprint, arg_min({_SQL}, event_id) AS sample_sql, {_DIGEST_SUMS}
  FROM events GROUP BY 1, 2
), r AS (
  SELECT *, row_number() OVER (PARTITION BY instance ORDER BY {_RANK}) AS rank FROM d
)"""

# Pairs that survive: everything but odd events with a noise line in between.
_PG_ROWS = """
WITH p AS (
  SELECT user_id, event_id, 'SELECT * FROM ' || event_type || ' WHERE id = ' || event_id || ';' AS sql, event_type,
    CASE event_id % 4 WHEN 0 THEN value WHEN 2 THEN value / 1000000 ELSE value / 1000 END AS secs
  FROM events WHERE event_id % 2 = 0 OR event_id % 7 <> 0
)"""

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ERROR_ROWS = r"""
WITH e AS (
  SELECT event_id, user_id, event_type, event_id % 6 AS kind,
    replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z ' || event_id || ' [Note] ' || CASE
      WHEN event_type <> 'error' THEN 'connection closed'
      WHEN event_id % 6 = 0 THEN 'InnoDB: Deadlock found when trying to get lock'
      WHEN event_id % 6 = 1 THEN 'InnoDB: Starting CRASH recovery from checkpoint'
      WHEN event_id % 6 = 2 THEN 'InnoDB: purge lag increased'
      WHEN event_id % 6 = 3 THEN 'replica SQL thread waits for purge'
      WHEN event_id % 6 = 4 THEN 'redo done at 0/1F'
      ELSE 'query timeout' END AS line
  FROM events
), c AS (
  SELECT * FROM e JOIN (VALUES (0, 'deadlock'), (1, 'crash_recovery'), (2, 'purge'), (3, 'purge'), (3, 'replication'), (4, 'crash_recovery')) k(kind, category)
  USING (kind) WHERE event_type = 'error'
)"""

_DOC_LINES = r"""
WITH s AS (SELECT doc_id, n_chars, string_split(text, chr(10)) AS ls, strlen(text) AS len FROM documents),
l AS (
  SELECT doc_id, n_chars, len + 1 AS total, i - 1 AS pos, ls[i] AS line
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s)
), o AS (
  SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(line) - 1 AS BIGINT) AS start FROM l
)"""


# The lines of landed files, and the byte of the file that each begins at.
_FILE_LINES = r"""
WITH s AS (SELECT doc_id // 100 AS file, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT file, doc_id, i AS pos, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s)),
o AS (
  SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY file) AS total,
    CAST(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY doc_id, pos) - strlen(line) - 1 AS BIGINT) AS start FROM l
)"""


def _doc_alerts(rules: dict[str, list[str]]) -> str:
    """Counts and first lines by document of the categories that any line falls into."""
    return (
        _DOC_LINES
        + f", t AS (SELECT CAST(doc_id AS VARCHAR) AS source, pos, line, {_LOWER.format('line')} AS low FROM l), c AS ("
        + " UNION ALL ".join(_doc_alert(name, phrases) for name, phrases in rules.items())
        + """) SELECT source, category, count(*) AS count, string_agg(line, '|' ORDER BY pos) FILTER (WHERE rn <= 3) AS sample_lines
FROM (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY pos) AS rn FROM c) GROUP BY 1, 2"""
    )


def _doc_alert(name: str, phrases: list[str]) -> str:
    tests = " OR ".join(f"contains(low, '{phrase}')" for phrase in phrases)
    return f"SELECT source, pos, line, '{name}' AS category FROM t WHERE {tests}"


ORACLES = {
    "slow_digest": f"SELECT {_SHAPE} AS fingerprint, arg_min({_SQL}, event_id) AS sample_sql, {_DIGEST_SUMS} FROM events GROUP BY 1",
    "slow_digest_by": _BY_INSTANCE + " SELECT * FROM d",
    "slow_digest_top": _BY_INSTANCE + " SELECT instance, rank, fingerprint, count, total_query_time_secs FROM r WHERE rank <= 2",
    "slow_record_scan": f"SELECT * EXCLUDE (avg_query_time_secs) FROM (SELECT {_SHAPE} AS fingerprint, {_DIGEST_SUMS} FROM events GROUP BY 1)",
    "pg_pairing": _PG_ROWS + " SELECT CAST(user_id AS VARCHAR) AS source, event_id, sql, secs AS query_time_secs, CAST(0 AS BIGINT) AS rows_sent FROM p",
    "pg_digest": _PG_ROWS + """
SELECT 'select * from ' || event_type || ' where id = ?;' AS fingerprint, arg_min(sql, event_id) AS sample_sql, count(*) AS count,
  CAST(sum(CAST(secs AS DECIMAL(20,9))) AS DOUBLE) AS total_query_time_secs,
  CAST(sum(CAST(secs AS DECIMAL(20,9))) AS DOUBLE) / count(*) AS avg_query_time_secs,
  CAST(0 AS DOUBLE) AS total_lock_time_secs, CAST(0 AS BIGINT) AS total_rows_sent, CAST(0 AS BIGINT) AS total_rows_examined
FROM p GROUP BY 1""",
    "fingerprint_text": r"""
SELECT doc_id, translate(trim(regexp_replace(regexp_replace(regexp_replace(text, '''[^'']*''|"[^"]*"|[0-9][0-9.]*', '?', 'g'),
  '[''"][\s\S]*$', ''), '[\s\p{Z}\x{85}]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fingerprint
FROM documents""",
    "alerts": _ERROR_ROWS + """
SELECT category, count(*) AS count, string_agg(line, '|' ORDER BY event_id) FILTER (WHERE rn <= 3) AS sample_lines
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY event_id) AS rn FROM c) GROUP BY 1""",
    "alerts_by": _ERROR_ROWS + """
SELECT 'db-' || (user_id % 10) AS instance, category, count(*) AS count, string_agg(line, '|' ORDER BY event_id) FILTER (WHERE rn <= 3) AS sample_lines
FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 10, category ORDER BY event_id) AS rn FROM c) GROUP BY 1, 2""",
    "alerts_rules": _doc_alerts(DOC_RULES),
    "alerts_many_rules": _doc_alerts(MANY_RULES),
    "digest_of_days": f"SELECT {_SHAPE} AS fingerprint, arg_min({_SQL}, event_id) AS sample_sql, {_DIGEST_SUMS} FROM events GROUP BY 1",
    "digest_of_months": f"""
SELECT month, fingerprint, sample_sql, count, total_query_time_secs, total_lock_time_secs, total_rows_sent, total_rows_examined FROM (
  SELECT strftime(ts, '%Y-%m') AS month, {_SHAPE} AS fingerprint, arg_min({_SQL}, event_id) AS sample_sql, {_DIGEST_SUMS} FROM events GROUP BY 1, 2)""",
    "tail_lines": _DOC_LINES + f"""
SELECT CAST(doc_id AS VARCHAR) AS source, back, line FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back
  FROM (SELECT doc_id, pos, {_STRIP.format('line')} AS line FROM l) WHERE line <> '') WHERE back <= {TAIL_LINES}""",
    "tail_bytes": _DOC_LINES + f"""
SELECT CAST(doc_id AS VARCHAR) AS source, back, line FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back
  FROM (SELECT doc_id, pos, {_STRIP.format('line')} AS line FROM o WHERE start >= total - {TAIL_BYTES}) WHERE line <> '') WHERE back <= {TAIL_LINES}""",
    "appended_since": _DOC_LINES + f""",
k AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN total + 99 ELSE n_chars // 2 END AS known FROM o), marked AS (SELECT *, CASE WHEN total < known OR total - known > {SEGMENT_BYTES} THEN greatest(total - {SEGMENT_BYTES}, 0) ELSE known END AS mark FROM k),
c AS (SELECT *, greatest(mark - start, 0) AS cut FROM marked WHERE start + strlen(line) + 1 > mark),
j AS (SELECT *, coalesce(list_min(list_filter(range(0, length(line) + 1), lambda n: strlen(left(line, n)) >= cut)), length(line)) AS skip FROM c)
SELECT CAST(doc_id AS VARCHAR) AS source, CAST(start + cut AS BIGINT) AS "offset",
  CASE WHEN strlen(left(line, skip)) > cut THEN chr(65533) ELSE '' END || substr(line, skip + 1) AS line FROM j""",
    "tail_of_files": _FILE_LINES + f"""
SELECT CAST(file AS BIGINT) AS file, back, line FROM (
  SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY start DESC) AS back
  FROM (SELECT file, start, {_STRIP.format('line')} AS line FROM o WHERE start >= total - {TAIL_BYTES}) WHERE line <> '') WHERE back <= {TAIL_LINES}""",
    "appended_to_files": _FILE_LINES + f""",
k AS (SELECT *, CASE WHEN file % 7 = 0 THEN 0 WHEN file % 5 = 0 THEN total + 100 ELSE total // 2 END AS known FROM o),
m AS (SELECT *, CASE WHEN total < known OR total - known > {SEGMENT_BYTES} THEN greatest(total - {SEGMENT_BYTES}, 0) ELSE known END AS mark FROM k),
c AS (SELECT *, greatest(mark - start, 0) AS cut FROM m WHERE start + strlen(line) + 1 > mark),
j AS (SELECT *, coalesce(list_min(list_filter(range(0, length(line) + 1), lambda n: strlen(left(line, n)) >= cut)), length(line)) AS skip FROM c),
r AS (SELECT file, start + cut AS place, CASE WHEN strlen(left(line, skip)) > cut THEN chr(65533) ELSE '' END || substr(line, skip + 1) AS line FROM j)
SELECT CAST(file AS BIGINT) AS file, CAST(place AS BIGINT) AS "offset", CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS line FROM r""",
    "latest_files": """
SELECT dir, path FROM (
  SELECT *, row_number() OVER (PARTITION BY dir ORDER BY page_id % 3 DESC, path DESC) AS rn
  FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS dir, url AS path FROM pages)) WHERE rn = 1""",
    "log_file_listing": "SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS newest_files FROM documents GROUP BY 1",
    "log_line_scan": r"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS raw FROM documents),
c AS (SELECT lang, raw, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line FROM l)
SELECT lang, count(*) AS lines, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes, CAST(sum(length(line)) AS BIGINT) AS chars,
  count(*) FILTER (WHERE line = '') AS empty_lines FROM c GROUP BY 1""",
    "log_paths": """
WITH f AS (
  SELECT o_custkey AS k, CASE WHEN o_custkey % 10 = 3 THEN '/abs/' || o_custkey ELSE '/pg/' || o_custkey || '/log' END || '/' ||
    CASE WHEN o_orderstatus = 'F' THEN 'server.log' ELSE 'f' || o_orderkey || '.log' END AS path, o_orderdate AS t FROM orders
), n AS (
  SELECT k, path AS newest FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, path DESC) AS rn FROM f) WHERE rn = 1
), h AS (
  SELECT k, any_value(path) AS server FROM f WHERE ends_with(path, '/server.log') GROUP BY 1
), w AS (
  SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 2 = 1 THEN 'postgres' ELSE 'mysql' END AS engine,
    CASE WHEN c_custkey % 6 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN coalesce(server, newest) ELSE newest END AS pg_log
  FROM customer LEFT JOIN n ON n.k = c_custkey LEFT JOIN h ON h.k = c_custkey
), s AS (
  SELECT *, CASE WHEN k % 9 = 0 THEN '/override/slow.log' WHEN k % 9 = 4 THEN NULL
    WHEN engine = 'postgres' THEN pg_log WHEN k % 5 <> 0 THEN '/log/' || c_name || '-slow.log' END AS slow FROM w
)
SELECT CAST(k AS VARCHAR) AS instance, engine, slow AS slow_log_path,
  CASE WHEN k % 8 = 3 THEN '/override/error.log' WHEN engine = 'postgres' THEN slow WHEN k % 4 <> 2 THEN '/log/' || c_name || '.err' END AS error_log_path
FROM s""",
    "slow_log_snapshot": _BY_INSTANCE + f""",
b AS (
  SELECT 'db-' || (user_id % 10) AS instance, CAST(sum(strlen(' ' || replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z' || chr(10) ||
    '# User@Host: app[app] @ localhost []' || chr(10) || '# Query_time: ' || value || ' Lock_time: 0.001 Rows_sent: ' ||
    json_extract_string(props, '$.k') || ' Rows_examined: ' || user_id || chr(10) || 'SET timestamp=1704067200;' || chr(10) ||
    replace({_SQL}, chr(10) || 'AND', chr(10) || '  AND'))) AS BIGINT) AS collected_bytes
  FROM events GROUP BY 1
)
SELECT instance, any_value(collected_bytes) AS collected_bytes, CAST(sum(count) AS BIGINT) AS parsed_entries, count(*) AS digest_count,
  string_agg(fingerprint || '=' || count, '|' ORDER BY rank) AS digests FROM r JOIN b USING (instance) GROUP BY 1""",
    "error_log_snapshot": _ERROR_ROWS + """,
n AS (SELECT 'db-' || (user_id % 10) AS instance, count(*) AS sampled_lines FROM events GROUP BY 1),
a AS (SELECT 'db-' || (user_id % 10) AS instance, category, count(*) AS count FROM c GROUP BY 1, 2)
SELECT instance, any_value(sampled_lines) AS sampled_lines, count(category) AS alert_count,
  coalesce(string_agg(category || '=' || count, '|' ORDER BY count DESC, category), '') AS alerts
FROM n LEFT JOIN a USING (instance) GROUP BY 1""",
}
