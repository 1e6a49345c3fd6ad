"""Log files that grow: a stream source that reads what was appended, once.

The offset of the stream is a map from file to the byte behind its last whole line, with check sums of how the file begins. A file that has shrunk, or begins otherwise
than before, was rotated: it is read from its start. A file that was renamed by the rotation begins as it did under its
old name, and goes on where that was read to. A line without its line break is not yet read; with ``idle_secs`` it is, once nothing was written for so long.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from dbgauge.sources.ranges import SPLIT_BYTES, ByteRange, as_lines, batches, locate

FORMAT = "growing_log_files"
_SCHEMA = "source string, block bigint, mid bigint, value binary, bytes bigint, file_size bigint"
#: Bytes of a file's beginning that are check-summed, as far as whole lines reach.
_HEADS = (64, 128, 256, 512, 1024, 2048, 4096)


class Piece(InputPartition):
    def __init__(self, source: str, start: int, stop: int, end: int, exact: bool):
        self.source, self.start, self.stop, self.end, self.exact = source, start, stop, end, exact


def same_file(old: dict, new: dict) -> bool:
    """Whether two states can be of one file that only grew in between; judged by the longest beginning that both have."""
    both = min(len(old["heads"]), len(new["heads"]))
    return new["end"] >= old["end"] and old["heads"][:both][-1:] == new["heads"][:both][-1:]


def appended_between(start: dict, end: dict) -> list[tuple[str, int, int]]:
    """(file, from, to) of what was appended between two offsets."""
    gone = {name: old for name, old in start.items() if name not in end or not same_file(old, end[name])}
    found = []
    for name, new in sorted(end.items()):
        if name in start and name not in gone:
            at = start[name]["end"]
        else:
            former = [old["end"] for other, old in gone.items() if other != name and old["heads"] and same_file(old, new)]
            at = max(former, default=0)
        if at < new["end"]:
            found.append((name, at, new["end"]))
    return found


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int, idle_secs: float | None):
        self.path, self.split_bytes, self.idle_secs = path, split_bytes, idle_secs
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, folder = locate(self.path)
        listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        prefix = "file://" if isinstance(system, fs.LocalFileSystem) else self.path.split("://")[0] + "://"
        state, self.known, before = {}, {}, self.known
        for info in listed:
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            name = prefix + info.path
            seen = (info.size, info.mtime_ns, self._idle(info))
            entry = before[name][1] if name in before and before[name][0] == seen else self._look(system, info, seen[2])
            self.known[name] = (seen, entry)
            state[name] = entry
        return state

    def _idle(self, info: fs.FileInfo) -> bool:
        return self.idle_secs is not None and info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 >= self.idle_secs

    @staticmethod
    def _look(system: fs.FileSystem, info: fs.FileInfo, idle: bool) -> dict:
        """The byte behind the last line break (the size, if the file is idle), and check sums of the beginning."""
        with system.open_input_file(info.path) as file:
            end = at = info.size
            while not idle and at > 0:
                size = min(1 << 16, at)
                at -= size
                file.seek(at)
                if (place := file.read(size).rfind(b"\n")) >= 0:
                    end = at + place + 1
                    break
                end = at
            file.seek(0)
            head = file.read(min(end, _HEADS[-1]))
        return {"end": end, "heads": [zlib.crc32(head[:size]) for size in _HEADS if size <= len(head)]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = []
        for name, low, high in appended_between(start, end):
            found += [Piece(name, at, min(at + self.split_bytes, high), high, at == low) for at in range(low, high, self.split_bytes)]
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        piece = ByteRange(partition.source, partition.start, partition.stop, partition.end, partition.exact)
        rows = ((partition.source, partition.start, at, line, size, partition.end) for at, line, size in piece.lines())
        return batches(rows)


class GrowingLogFiles(DataSource):
    """Options: ``path`` (a folder), ``splitBytes``, ``idleSecs``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        idle = self.options.get("idleSecs")
        return GrowingLogReader(self.options["path"], int(self.options.get("splitBytes") or SPLIT_BYTES), None if idle is None else float(idle))


def read_growing_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, idle_secs: float | None = None) -> DataFrame:
    """A stream of the lines of the files in a folder, as they are written: the columns of ``read_log_lines``, ``mid`` being the byte a line begins at.

    The offset has one small entry for each file of the folder, as the file source has; what is appended is read in pieces of ``split_bytes`` by tasks.
    Text that a rotation removes before a batch has read it is lost, and a file cut during a batch fails it.
    """
    spark.dataSource.register(GrowingLogFiles)
    reader = spark.readStream.format(FORMAT).option("path", path).option("splitBytes", str(split_bytes))
    if idle_secs is not None:
        reader = reader.option("idleSecs", str(idle_secs))
    return as_lines(reader.load())
