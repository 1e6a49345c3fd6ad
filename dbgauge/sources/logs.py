"""Landed log files as DataFrames.

A text file has no line numbers. ``(source, block, mid)`` orders its rows instead: the file, the byte
at which the split starts, and a running id inside the scan task. All three are taken in the scan,
before any shuffle. A block is one file split, so its size is bounded by
``spark.sql.files.maxPartitionBytes`` however large the file is; the operators that need neighbouring
lines work block by block for that reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the text that starts a slow-log record.
RECORD_MARK = "# Time:"

BLOCK_ROWS = 65_536


def chomp(line: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line: source, block, mid, line, bytes (line break included), file_size.

    Lines end at LF only; a lone CR does not end a line. Bad UTF-8 becomes U+FFFD.
    """
    rows = line_rows(spark.read.option("lineSep", "\n").text(path)).withColumn("mid", F.monotonically_increasing_id())
    return rows.select("source", "block", "mid", "line", "bytes", "file_size")


def line_rows(scan: DataFrame) -> DataFrame:
    """``source, block, line, bytes, file_size`` of a line scan, batch or stream. ``mid`` comes from the batch frame, before any shuffle."""
    return scan.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        chomp(F.make_valid_utf8("value")).alias("line"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def lines_from_table(
    rows: DataFrame, source: Column, position: Column, line: Column, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows of a table as log lines; ``position`` orders them and is unique within ``source``.

    A block is named by its first position and holds at most ``block_rows`` lines.
    """
    return rows.select(
        source.cast("string").alias("source"),
        (position - F.pmod(position, F.lit(block_rows))).cast("bigint").alias("block"),
        position.cast("bigint").alias("mid"),
        line.alias("line"),
        (F.octet_length(line) + 1).cast("bigint").alias("bytes"),
    )


def read_slow_log_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per ``# Time:`` record: source, block, mid, record.

    The record mark is the row separator of the scan, so files split and no shuffle is needed to
    bring the lines of a record together. What a file holds before its first mark is dropped.
    """
    return drop_leading_text(record_rows(spark.read.option("lineSep", f"\n{RECORD_MARK}").text(path)).withColumn("mid", F.monotonically_increasing_id()))


def record_rows(scan: DataFrame) -> DataFrame:
    """``source, block, record`` of a record-delimited text scan, batch or stream."""
    return scan.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("record"),
    )


def drop_leading_text(rows: DataFrame) -> DataFrame:
    """Drop the first row of each file that does not begin with the record mark.

    Only the first row of a file can hold other text than a record, whatever it looks like; later rows have lost
    their mark to the row separator. A scan task hands out the rows of a split in order, so the first row of a file is the first one of its block 0: it is told in
    passing, in the scan's own stage, and no record is shuffled or read twice. ``rows`` have to come from the scan as they are, with ``mid``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            block, source = batch.column("block").to_numpy(), batch.column("source")
            if not batch.num_rows:
                continue
            first = block == 0
            if first.any():
                other = np.append((source[0].as_py(), int(block[0])) != last, pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False))
                other[1:] |= block[1:] != block[:-1]
                first &= other
                leading = first & ~pc.starts_with(batch.column("record"), RECORD_MARK).to_numpy(zero_copy_only=False)
            else:
                leading = first
            last = (source[-1].as_py(), int(block[-1]))
            yield batch.filter(pa.array(~leading)) if leading.any() else batch

    kept = rows.select("source", "block", "mid", "record")
    return kept.mapInArrow(run, "source string, block bigint, mid bigint, record string")
