"""WARC archives through a table of chunks: no record is ever held as a whole."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import materialize, read_table
from dbgauge.session import scratch_path

#: Bytes of a chunk, payload bytes from which equal payloads are stored once, bytes after which a task begins another file.
CHUNK_BYTES, REVISIT_BYTES, FILE_BYTES = 256 * 1024, 1000, 512 * 1024 * 1024
_READ_BYTES = 256 * 1024
_URI_ESCAPE = re.compile(r"[\x00-\x20\x7f]")


def plan_records(pages: DataFrame) -> DataFrame:
    """Rows of (page_id, url, payload, payload_digest, payload_bytes, refers_to) for pages (page_id, url, html).

    Of pages with equal payloads of at least REVISIT_BYTES bytes, the largest page_id is a response and others refer to it. Payloads are told apart by
    SHA-256. Null html is an empty payload, a null url an empty one. Null ids are smaller than others; rows that repeat the
    largest id are all responses. Keepers are aggregated in each task before the shuffle, and the join is of two exchanges, so many copies of one page are split.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    sized = rows.withColumn("payload_bytes", F.length("payload").cast("bigint")).withColumn("same", F.sha2("payload", 256))
    keepers = sized.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    keepers = materialize(keepers.select("same", "keeper"), "warc-keepers")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return sized.join(keepers, "same", "left").select("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"), "payload_bytes", refers.alias("refers_to"))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of (record_id, chunk_no, chunk, …): the payload of each record in pieces, in order; a record without payload has one empty chunk."""
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    pieces = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk_bytes)).cast("int")
    cut = records.withColumn("record_id", F.expr("uuid()")).withColumn("payload", stored)
    numbered = cut.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    chunk = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select("record_id", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", F.length("payload").cast("bigint").alias("stored_bytes"), "chunk_no", chunk.alias("chunk"))


def _header(row: dict) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{row['record_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_URI_ESCAPE.sub(lambda m: f'%{ord(m[0]):02X}', row['url'])}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Page-Id: {'' if row['page_id'] is None else row['page_id']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {row['stored_bytes']}",
    ]
    if row["refers_to"] is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {row['refers_to']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write gzip WARC files, one member for each record, and return their list (path, size, records).

    Each task streams its chunks into files of its own, whose names no other attempt uses; the list, written as a table, has only those of the
    attempts that counted. The path has to be one that all executors can write to.
    """
    columns = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, size, records, packer, done = None, "", 0, 0, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {column: batch.column(column)[at].as_py() for column in columns}
                if row["chunk_no"] == 0:
                    if out is not None and size >= file_bytes:
                        out.close()
                        done.append((f"{path}/{name}", size, records))
                        out = None
                    if out is None:
                        name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packer, left = zlib.compressobj(1, zlib.DEFLATED, 31), row["stored_bytes"]
                    size += out.write(packer.compress(_header(row)))
                    records += 1
                left -= len(row["chunk"])
                size += out.write(packer.compress(row["chunk"]))
                if not left:
                    size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", size, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "records"])

    return materialize(chunks.mapInArrow(run, "path string, size bigint, records bigint"), "warc-files")


class _Archive:
    """A gzip WARC file as a stream of bytes: lines, and pieces of bounded size."""

    def __init__(self, stream):
        self.stream, self.unpacker, self.packed, self.held = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = bytes(self.stream.read(_READ_BYTES))
                if not self.packed:
                    return False
            got = self.unpacker.decompress(self.packed, _READ_BYTES)
            self.packed = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if got:
                self.held += got
                return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        line = bytes(self.held[:at])
        del self.held[: at + 2]
        return line

    def piece(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("the archive ends within a record")
        got = bytes(self.held[:most])
        del self.held[:most]
        return got


def read_records(stream) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and the pieces of the block of each record, in order. The pieces have to be used up before the next record."""
    archive = _Archive(stream)
    while (line := archive.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        head = {}
        while line := archive.line():
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        left = int(head["content-length"])

        def pieces(left: int = left) -> Iterator[bytes]:
            while left:
                got = archive.piece(left)
                left -= len(got)
                yield got

        yield head, pieces()


RECORD = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, declared_digest string, declared_bytes bigint"


def read_chunks(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The chunk table of archives: a row for each piece of a record, with the SHA-1 of the record up to and with it.

    The running digest of the last piece (is_last) is that of the block. Files are dealt over tasks by name; pieces are bounded,
    whatever the size of a record. A block without bytes has one empty piece. With ``keep_payload`` false the pieces' bytes are left out, digests and sizes stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    yield from _batches(stream, keep_payload)

    tasks = max(1, files.count())
    schema = f"{RECORD}, chunk_no int, chunk binary, chunk_bytes bigint, running_digest string, is_last boolean"
    return files.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def _batches(stream, keep_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [*[part.split()[0] for part in RECORD.split(", ")], "chunk_no", "chunk", "chunk_bytes", "running_digest", "is_last"]
    rows, held = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    for head, pieces in read_records(stream):
        number = lambda key: int(head[key]) if head.get(key) else None  # noqa: B023, E731
        record = (head["warc-record-id"][10:-1], number("x-page-id"), head["warc-target-uri"], head["warc-type"], number("x-refers-to-page-id"), head["warc-payload-digest"].partition(":")[2], number("x-payload-length"))
        digest, left, at = hashlib.sha1(), int(head["content-length"]), 0
        while True:
            piece = next(pieces, b"")
            digest.update(piece)
            left -= len(piece)
            rows.append((*record, at, piece if keep_payload else None, len(piece), digest.hexdigest(), left == 0))
            held, at = held + (len(piece) if keep_payload else 0) + 200, at + 1
            if held >= 1 << 22:
                yield flush()
                rows, held = [], 0
            if not left:
                next(pieces, None)
                break
    if rows:
        yield flush()


def read_summary(files: DataFrame) -> DataFrame:
    """One row for each record: what its chunks add up to. A response that is not what its header says is an error."""
    chunks = read_chunks(files, keep_payload=False)
    whole = chunks.groupBy(*[part.split()[0] for part in RECORD.split(", ")]).agg(F.sum("chunk_bytes").alias("block_bytes"), F.max(F.when(F.col("is_last"), F.col("running_digest"))).alias("block_digest"))
    wrong = (F.col("record_type") == "response") & ((F.col("block_bytes") != F.col("declared_bytes")) | (F.col("block_digest") != F.col("declared_digest")))
    return whole.withColumn("block_digest", F.when(wrong, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))).otherwise(F.col("block_digest")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_table(plan_records(read_table(spark, sf_dir, "pages")))
    found = read_summary(write_archives(chunks, scratch_path(spark, "warc")))
    revisit = F.col("record_type") == "revisit"
    return found.select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("block_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
