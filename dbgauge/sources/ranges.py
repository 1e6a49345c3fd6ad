"""Byte ranges of log files: their lines, without reading the rest of the file.

A text scan reads whole files. Here tasks open files at a byte, so the tail of a large log, or what was appended to it, costs what it is long.
Files are opened through ``pyarrow.fs`` (local paths, ``hdfs``, ``s3``, ``gs``); for stores that only Spark's readers open, use ``read_log_lines`` with
``operators.segments``. A row is a line: ``source``, ``block`` (where the piece begins that the line begins in), ``mid`` (the byte it begins at), ``line``,
``bytes`` (line break included) and ``file_size``. ``(source, block, mid)`` orders lines as in a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.functions.text import WS_CHARS, strip_ws
from dbgauge.operators.segments import segment_start
from dbgauge.sources.logs import chomp

#: Bytes of a range that one task reads, and of one read.
SPLIT_BYTES, BUFFER = 64 << 20, 1 << 20
#: Bytes read at a time of the rest of a range's last line.
_REST = 1 << 16
_BATCH_LINES, _BATCH_BYTES = 8192, 8 << 20

_ROWS = "source string, block bigint, mid bigint, value binary, bytes bigint, file_size bigint"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [part.split()[0] for part in _ROWS.split(", ")]


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location; ``file:/x``, ``file:///x`` and ``/x`` are the same."""
    local = re.fullmatch(r"file:/+(.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), f"/{local.group(1)}" if local else path
    return fs.FileSystem.from_uri(path)


class ByteRange:
    """The lines of a file that begin at ``start`` or later and before ``stop``; nothing is read from ``size`` on.

    With ``exact`` a line begins at ``start`` whatever stands before it; otherwise the first line is the first behind a line break at ``start - 1`` or later. A
    line is read to its end, also behind ``stop``.
    """

    def __init__(self, path: str, start: int, stop: int, size: int, exact: bool, counted: Accumulator | None = None):
        self.path, self.start, self.stop, self.size, self.exact, self.counted = path, start, stop, size, exact, counted

    def _read(self, file: pa.NativeFile, at: int, count: int) -> bytes:
        file.seek(at)
        data = file.read(count)
        if len(data) < count:
            raise OSError(f"{self.path} ended at byte {at + len(data)}, before {at + count}: it was cut while it was read")
        if self.counted is not None:
            self.counted.add(count)
        return data

    def lines(self) -> Iterator[tuple[int, bytes, int]]:
        """(first byte, line without its break, bytes with it)."""
        if self.start >= min(self.stop, self.size):
            return
        system, place = locate(self.path)
        with system.open_input_file(place) as file:
            at = self.start if self.exact or not self.start else self.start - 1
            first, open_ = at, self.exact or not self.start  # where the bytes held begin; whether a line begins there
            held: list[bytes] = []
            while at < self.size and (not open_ and at < self.stop or open_ and (first < self.stop)):
                wanted = self.stop - at if at < self.stop else _REST
                data = self._read(file, at, min(BUFFER, wanted, self.size - at))
                at += len(data)
                parts = data.split(b"\n")
                for part in parts[:-1]:
                    held.append(part)
                    line = b"".join(held)
                    held = []
                    if open_:
                        yield first, line, len(line) + 1
                        first += len(line) + 1
                    else:
                        open_, first = True, at - len(data) + len(part) + 1
                    if first >= self.stop:
                        return
                if open_ or len(parts) > 1:
                    held.append(parts[-1])
            if open_ and held and any(held) and first < self.stop:
                line = b"".join(held)
                yield first, line, len(line) + 1

    def last_lines(self, count: int) -> list[tuple[int, bytes]]:
        """(first byte, line) of the last ``count`` lines that are not blank, last first; read from the end, so no more than they need and one buffer."""
        found: list[tuple[int, bytes]] = []
        if self.start >= self.size:
            return found
        system, place = locate(self.path)
        with system.open_input_file(place) as file:
            floor = max(0, self.start - 1)
            at = end = self.size  # end: where the line ends that is being put together
            held: list[bytes] = []  # its parts, last first
            while at > floor:
                size = min(BUFFER, at - floor)
                at -= size
                *parts, last = self._read(file, at, size).split(b"\n")
                held.append(last)
                while parts:
                    end = self._keep(found, held, end)
                    if len(found) >= count:
                        return found
                    held = [parts.pop()]
            if self.start == 0:
                self._keep(found, held, end)
        return found

    @staticmethod
    def _keep(found: list, held: list[bytes], end: int) -> int:
        """Add a line if it is not blank; returns where the line before it ends."""
        line = b"".join(reversed(held))
        if line.decode("utf-8", "replace").strip(WS_CHARS):
            found.append((end - len(line), line))
        return end - len(line) - 1


def batches(lines: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    rows: list[tuple] = []
    held = 0
    for row in lines:
        rows.append(row)
        held += len(row[3])
        if len(rows) >= _BATCH_LINES or held >= _BATCH_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _TYPES)], names=_NAMES)


def as_lines(rows: DataFrame) -> DataFrame:
    """Raw rows as log lines: bad UTF-8 becomes U+FFFD, one carriage return at the end goes."""
    return rows.select("source", "block", "mid", chomp(F.make_valid_utf8(F.col("value").cast("string"))).alias("line"), "bytes", "file_size")


def log_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, path, file_size`` of the files below a path, from their listing."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("_metadata.file_path").alias("source"), "path", F.col("length").alias("file_size"))


def _spread(frame: DataFrame, *keys: str) -> DataFrame:
    """A task may get many rows, but all of few: a fixed number of partitions is not joined again because its rows are narrow."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_ranges(ranges: DataFrame, split_bytes: int = SPLIT_BYTES, counted: Accumulator | None = None) -> DataFrame:
    """Lines of byte ranges (``source, path, start, file_size``) up to the end of each file; the first begins exactly at ``start``.

    A range is cut into pieces of ``split_bytes``, which are dealt over the tasks. ``counted`` sums the bytes read.
    """
    pieces = ranges.where(F.col("start") < F.col("file_size")).select(
        "source", "path", "file_size", "start", F.explode(F.sequence("start", F.col("file_size") - 1, F.lit(split_bytes))).alias("block")
    )

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for row in part.to_pylist():
                    piece = ByteRange(row["path"], row["block"], row["block"] + split_bytes, row["file_size"], row["block"] == row["start"], counted)
                    for at, line, size in piece.lines():
                        yield row["source"], row["block"], at, line, size, row["file_size"]

        return batches(rows())

    return as_lines(_spread(pieces, "source", "block").mapInArrow(read, _ROWS))


def read_appended(
    spark: SparkSession, path: str | list[str], checkpoints: DataFrame, max_bytes: int, split_bytes: int = SPLIT_BYTES, counted: Accumulator | None = None
) -> DataFrame:
    """What ``appended_since(read_log_lines(path), checkpoints, max_bytes)`` gives, reading the appended bytes only."""
    known = checkpoints.select("source", F.col("offset").cast("bigint").alias("_known"))
    files = log_files(spark, path).join(known, "source", "left")
    ranges = files.withColumn("start", segment_start(F.col("file_size"), F.col("_known"), max_bytes))
    return read_ranges(ranges, split_bytes, counted).select("source", "block", "mid", "line", "bytes", F.col("mid").alias("offset"))


def read_tail(
    spark: SparkSession, path: str | list[str], max_lines: int, max_bytes: int | None = None, counted: Accumulator | None = None
) -> DataFrame:
    """What ``tail_lines(read_log_lines(path), max_lines, max_bytes)`` gives, reading each file from its end.

    A file is read backwards until it has given ``max_lines`` lines that are not blank, or ``max_bytes`` are read; one task reads one file's tail.
    """
    start: Column = F.lit(0).cast("bigint") if max_bytes is None else F.greatest(F.col("file_size") - max_bytes, F.lit(0).cast("bigint"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for row in part.to_pylist():
                    tail = ByteRange(row["path"], row["start"], row["file_size"], row["file_size"], False, counted)
                    for back, (at, line) in enumerate(tail.last_lines(max_lines), 1):
                        yield row["source"], row["start"], at, line, back, row["file_size"]

        return batches(rows())

    files = _spread(log_files(spark, path).select("source", "path", "file_size", start.alias("start")), "source")
    found = as_lines(files.mapInArrow(read, _ROWS))
    return found.select("source", "block", "mid", strip_ws(F.col("line")).alias("line"), F.col("bytes").cast("int").alias("back"))
