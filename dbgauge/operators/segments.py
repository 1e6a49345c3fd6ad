"""Parts of log files: the tail, and what was appended since a checkpoint.

Both need byte offsets, which are running sums over a file. They are built in two levels: totals per
block (one small row each) are summed along the file first, then only the blocks that can matter are
read for their lines, each block by itself. No task holds more than one block of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbgauge.functions.text import strip_ws

_BLOCK = ["source", "block"]


def _filled(line: Column) -> Column:
    return strip_ws(line) != ""


def block_offsets(lines: DataFrame) -> DataFrame:
    """Per block: first byte, byte behind the last, non-blank lines in later blocks, file length."""
    size = F.max("file_size") if "file_size" in lines.columns else F.lit(None).cast("bigint")
    blocks = lines.groupBy(*_BLOCK).agg(
        F.sum("bytes").alias("block_bytes"),
        F.count_if(_filled(F.col("line"))).alias("block_lines"),
        size.alias("file_size"),
    )
    along = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("source").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    ends = blocks.withColumn("block_end", F.sum("block_bytes").over(along))
    return ends.select(
        *_BLOCK,
        (F.col("block_end") - F.col("block_bytes")).alias("block_start"),
        "block_end",
        F.coalesce(F.sum("block_lines").over(later), F.lit(0)).alias("lines_behind"),
        F.coalesce("file_size", F.max("block_end").over(whole)).alias("length"),
    )


def _from_offset(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines that end behind ``start`` (a column of ``blocks``), with the ``offset`` of their first byte."""
    needed = blocks.filter(F.col("block_end") > F.col("start")).select(*_BLOCK, "block_start", "start")
    in_block = Window.partitionBy(*_BLOCK).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(needed, _BLOCK).withColumn("_end", F.col("block_start") + F.sum("bytes").over(in_block))
    return placed.withColumn("offset", F.col("_end") - F.col("bytes")).filter(F.col("_end") > F.col("start"))


def tail_lines(lines: DataFrame, max_lines: int, max_bytes: int | None = None) -> DataFrame:
    """The last non-blank lines of each source, stripped.

    ``max_bytes`` cuts first (whole lines only), then blank lines go, then the last ``max_lines`` stay.
    """
    blocks = block_offsets(lines)
    if max_bytes is None:
        needed = blocks.filter(F.col("lines_behind") < max_lines).select(*_BLOCK)
        kept = lines.join(needed, _BLOCK)
    else:
        blocks = blocks.withColumn("start", F.greatest(F.col("length") - max_bytes, F.lit(0).cast("bigint")))
        blocks = blocks.filter(F.col("lines_behind") < max_lines)
        kept = _from_offset(lines, blocks).filter(F.col("offset") >= F.col("start"))
    text = kept.select(*_BLOCK, "mid", strip_ws(F.col("line")).alias("line")).filter(F.col("line") != "")
    back = Window.partitionBy("source").orderBy(F.col("block").desc(), F.col("mid").desc())
    return text.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= max_lines)


def segment_start(length: Column, offset: Column, max_bytes: int) -> Column:
    """Where reading starts: the checkpoint, or ``max_bytes`` before the end if the file shrank below
    the checkpoint or grew by more than ``max_bytes``. No checkpoint means 0."""
    known = F.coalesce(offset, F.lit(0).cast("bigint"))
    last = F.greatest(length - max_bytes, F.lit(0).cast("bigint"))
    return F.when((length < known) | (length - known > max_bytes), last).otherwise(known)


def appended_since(lines: DataFrame, checkpoints: DataFrame, max_bytes: int) -> DataFrame:
    """Lines appended behind each source's checkpoint (columns ``source, offset``), with ``offset``.

    A checkpoint within a line (the writer was not done with it) gives the rest of that line.

    The checkpoint meets the block table, not the lines, so a source with many lines is no hot key.
    """
    known = checkpoints.select("source", F.col("offset").cast("bigint").alias("_known"))
    blocks = block_offsets(lines).join(known, "source", "left")
    blocks = blocks.withColumn("start", segment_start(F.col("length"), F.col("_known"), max_bytes))
    cut = F.greatest(F.col("start") - F.col("offset"), F.lit(0)).cast("int")
    rest = F.make_valid_utf8(F.substring(F.col("line").cast("binary"), cut + 1, F.octet_length("line")).cast("string"))
    line = F.when(cut > 0, rest).otherwise(F.col("line"))
    return _from_offset(lines, blocks).select(
        *_BLOCK, "mid", line.alias("line"), (F.col("bytes") - cut).alias("bytes"), (F.col("offset") + cut).alias("offset")
    )
