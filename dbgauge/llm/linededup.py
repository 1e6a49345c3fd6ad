"""Line deduplication over content-defined chunks of lines. Built-in column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import materialize, read_table

#: A boundary follows a line whose rolling hash is divisible by DIVISOR and whose predecessor's is not.
DIVISOR, BASE = 2, 31
#: Lines that are not blank in a chunk that may be removed, at least.
LEAST_LINES = 2
_NO_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that it is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(hashes: Column) -> Column:
    """Zero-based first lines of the chunks.

    The rolling hash of a line covers it and the line before. Boundaries depend on three lines only, so an
    inserted or deleted line moves the boundaries near it and no others. Two boundaries never follow each other: only
    a last chunk can be of one line.
    """
    rolled = F.transform(hashes, lambda h, at: (h + BASE * F.coalesce(F.get(hashes, at - 1), F.lit(0))) % DIVISOR)
    begins = lambda r, at: (at == 0) | ((at >= 2) & (F.get(r, at - 1) == 0) & (F.get(r, at - 2) != 0))
    return _let(rolled, lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda at: begins(r, at)))


def line_chunks(text: Column) -> Column:
    """Array of (start, len, text, eligible) over the lines of a text; null for a null text."""

    def hash_of(line: Column) -> Column:
        # 28 bits of the line's MD5, which any SQL engine can compute
        return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")

    def chunk(lines: Column, starts: Column, start: Column, at: Column) -> Column:
        size = F.coalesce(F.get(starts, at + 1), F.size(lines)) - start
        full = lambda part: F.size(F.filter(part, lambda line: F.trim(line) != "")) >= LEAST_LINES
        return _let(F.slice(lines, start + 1, size), lambda part: F.struct(start.alias("start"), size.alias("len"), F.array_join(part, "\n").alias("text"), full(part).alias("eligible")))

    def chunks(lines: Column) -> Column:
        return _let(F.transform(lines, hash_of), lambda hashes: _let(_starts(hashes), lambda starts: F.transform(starts, lambda start, at: chunk(lines, starts, start, at))))

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), chunks))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Remove repeated multi-line chunks: all but the first, by (doc_id, line, hash of the text), of those with equal bytes.

    Returns the columns of ``documents`` with the new text (n_chars follows it, if there) and n_lines, n_chunks, removed_chunks,
    removed_lines; input columns of these four names are replaced. Chunks of fewer than two lines that are not blank stay. A text of which
    all is removed is empty, and its row stays. Null texts stay null with counts of 0. A null id stands before all
    others. Rows that share an id, or have none, are documents of their own; those that repeat an id and text keep the same, as they have the same places. An empty table gives no row.

    1. Chunk texts are counted by an aggregate on their bytes, combined in each task: a chunk of most documents is one row a
       task. 2. Repeated chunks meet narrow (document, line, hash) rows in a join of two exchanges that Spark can split where it is
       skewed. 3. What a document repeats, which its own length bounds, goes back to it, and bytes are compared with bytes.
    """
    names = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    own = documents.drop(*names).withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))).withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    chunks = own.select("__id", "__h", F.explode(line_chunks(F.col("text"))).alias("c")).where("c.eligible")
    # id, line, and 31 bits of the text's hash, in one number that an aggregate can update in place
    shift = F.lit(1 << 31).cast("decimal(11,0)")
    place = (F.col("__id").cast("decimal(38,0)") * shift + F.col("c.start")).cast("decimal(38,0)") * shift + F.col("__h").bitwiseAND(F.lit((1 << 31) - 1))
    placed = chunks.select("__id", "__h", place.cast("decimal(38,0)").alias("place"), F.col("c.start").alias("start"), F.col("c.text").alias("chunk"))
    counted = placed.groupBy("chunk").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(counted.select(F.xxhash64("chunk").alias("hash"), "chunk", "first"), "repeated-chunks")
    places = placed.select("__id", "__h", "place", "start", F.xxhash64("chunk").alias("hash"))
    later = places.join(repeated, "hash").where("place > first")
    known = later.groupBy("__id", "__h").agg(F.collect_set(F.struct("start", "chunk")).alias("__known"))

    def repeats(c: Column) -> Column:
        return F.coalesce(F.exists("__known", lambda k: (k["start"] == c["start"]) & (k["chunk"] == c["text"])), F.lit(False)) & c["eligible"]

    def sorted_out(chunks: Column) -> Column:
        kept, gone = F.filter(chunks, lambda c: ~repeats(c)), F.filter(chunks, repeats)
        lines = lambda part: F.aggregate(part, F.lit(0), lambda n, c: n + c["len"])
        return F.struct(F.array_join(F.transform(kept, lambda c: c["text"]), "\n").alias("text"), lines(chunks).alias("n_lines"), F.size(chunks).alias("n_chunks"), F.size(gone).alias("removed_chunks"), lines(gone).alias("removed_lines"))

    result = own.join(known, ["__id", "__h"], "left").withColumn("__out", F.when(F.col("text").isNotNull(), _let(line_chunks(F.col("text")), sorted_out)))
    made = {name: F.coalesce(F.col(f"__out.{name}"), F.lit(0)) for name in names} | {"text": F.col("__out.text")}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.length("__out.text").cast(documents.schema["n_chars"].dataType)
    return result.withColumns(made).select(*[name for name in documents.columns if name not in names], *names)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length(text).alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines
), rolled AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY pos), 0)) % 2 AS r FROM hashed
), marked AS (
  SELECT *, CASE WHEN pos = 0 OR (pos >= 2 AND lag(r, 1) OVER w = 0 AND lag(r, 2) OVER w <> 0) THEN 1 ELSE 0 END AS b
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM marked
), chunks AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS n,
         sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) >= 2 AS eligible
  FROM numbered GROUP BY 1, 2
), judged AS (
  SELECT *, eligible AND row_number() OVER (PARTITION BY eligible, t ORDER BY doc_id, chunk) > 1 AS gone FROM chunks
), put AS (
  SELECT doc_id, sum(n) AS n_lines, count(*) AS n_chunks, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS removed_chunks,
         sum(CASE WHEN gone THEN n ELSE 0 END) AS removed_lines,
         coalesce(string_agg(t, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_chunks, 0)::INTEGER AS n_chunks,
       coalesce(removed_chunks, 0)::INTEGER AS removed_chunks, coalesce(removed_lines, 0)::INTEGER AS removed_lines,
       length(coalesce(kept, ''))::INTEGER AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN put USING (doc_id)
"""
