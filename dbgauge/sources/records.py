"""Collection records as JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.schemas import RECORD, SUMMARY

FILE_COLUMNS = ["file", "file_size"]

#: Records of a compressed file, which cannot be split: some 50 MB of text at a few KB each.
COMPRESSED_RECORDS = 20_000


def read_records(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """``file, file_size, text, record``: one row per file, or per line with ``multiline=False``.

    ``record`` is a VARIANT; text that is not one JSON value gives NULL, also that of an empty file; blank lines
    of a line file are no records. One file holds one record of at most a
    few MB, so reading whole files keeps tasks small; use line files to land many records together. Compressed
    files are told by their names; ``file_size`` is that of the file as it is stored.
    """
    raw = spark.read.text(path, wholetext=multiline)
    found = raw.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.make_valid_utf8("value").alias("text"),
    )
    if not multiline:
        return with_variant(found.filter(F.trim("text") != ""))
    # a scan skips files of no bytes; the index of files, which it holds on the driver anyway, has them
    listed = spark.createDataFrame([(name,) for name in raw.inputFiles()], "_path string").select(_one_form(F.col("_path")).alias("_path"))
    # names and lengths alone: no content is read for them
    filled = spark.read.format("binaryFile").load(path).where("length > 0").select(_one_form(F.col("_metadata.file_path")).alias("_path"))
    empty = listed.join(filled, "_path", "left_anti").select(
        F.regexp_extract("_path", "([^/]*)$", 1).alias("file"), F.lit(0).cast("bigint").alias("file_size"), F.lit("").alias("text")
    )
    return with_variant(found.unionByName(empty))


def _one_form(path: Column) -> Column:
    """A path whose scheme has one slash; listings and scans write ``file:///`` and ``file:/``."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def _alone(text: Column) -> Column:
    """The text as a VARIANT if it is one JSON value and nothing else; NULL otherwise.

    A parser stops behind the first value. As the first of exactly two items of an array, text with junk or another
    value behind it is no JSON or makes a third item.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end"]')))
    ends = (F.try_variant_get(pair, "$[1]", "string") == "end") & F.variant_get(pair, "$[2]", "variant").isNull()
    return F.when(ends, F.variant_get(pair, "$[0]", "variant"))


def with_variant(records: DataFrame, text: str = "text") -> DataFrame:
    """Add ``record``; text that is empty, no JSON, or has more behind its value, or an object that repeats a key, gives NULL."""
    return records.withColumn("record", _alone(F.col(text)))


def typed_records(records: DataFrame, text: str = "text", keep: Sequence[str] = FILE_COLUMNS) -> DataFrame:
    """Kept columns and the record's fields as typed columns; only the fields used later are parsed."""
    kept = [name for name in keep if name in records.columns]
    return records.select(*kept, F.from_json(F.when(_alone(F.col(text)).isNotNull(), F.col(text)), RECORD).alias("_r")).select(*kept, "_r.*")


def read_summaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Expected record summaries: JSON files that hold an array of summaries, or one summary per line."""
    return spark.read.schema(SUMMARY).option("multiLine", "true").json(path)


def read_ordered_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries of one JSON array with their ``position`` in it; such a file is small enough to be one value."""
    parsed = F.from_json("value", f"array<struct<{SUMMARY}>>")
    return spark.read.text(path, wholetext=True).select(F.posexplode(parsed).alias("position", "_s")).select(F.col("position").cast("bigint"), "_s.*")


def write_records(records: DataFrame, path: str, pretty: bool = False, mode: str = "error", compression: str = "none") -> None:
    """Write records as JSON, nulls included; ``pretty`` indents, one record per file as it spans lines.

    Field names are most of a record, so ``compression`` by ``gzip`` keeps large tables of records to a small part of
    their size; such files hold at most COMPRESSED_RECORDS, so that many tasks can read them.
    """
    options = {"ignoreNullFields": "false"}
    if pretty:
        options["pretty"] = "true"
    body = F.to_json(F.struct(*records.columns), options)
    writer = records.select(body.alias("value")).write.mode(mode).option("compression", compression)
    most = 1 if pretty else None if compression == "none" else COMPRESSED_RECORDS
    (writer.option("maxRecordsPerFile", most) if most else writer).text(path)
