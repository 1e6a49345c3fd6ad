"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dbgauge.llm.common import SLICE, map_texts, read_table, shingle_hashes

#: Hashes kept by a sketch (the error of a resemblance is at most 0.5 / sqrt(K)), and words of a shingle.
K, WIDTH = 128, 5


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending; all of them if there are fewer. Empty without words."""
    return np.unique(shingle_hashes(text, width))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together. Shingles that cross the seam belong to neither part."""
    return np.union1d(a, b)[:k]


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1. Two empty sketches are alike, an empty and another are not."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    if not len(a):
        return 1.0
    alike = resemblance(a, b, k)
    shared = alike * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + alike)
    return min(1.0, shared / distinct_shingles(a, k))


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def with_sketch(documents: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Append fingerprint (string) and distinct_shingles (double). A null text is an empty one; other columns stay."""

    def make():
        def compute(texts):
            sketches = [sketch(t, k, width) for t in texts]
            return [[encode(s) for s in sketches], [distinct_shingles(s, k) for s in sketches]]

        return compute

    return map_texts(documents, text, make, "fingerprint string, distinct_shingles double")


def merge_sketches(sketched: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch for each group of parts: (by…, fingerprint, distinct_shingles).

    The k smallest distinct hashes of a group are cut in each task before the shuffle (a group limit of the
    window), so a group with most rows sends k rows a task. A group whose parts are all empty has an empty sketch; null keys are a group.
    """
    unpack = map_texts(
        sketched.select(*by, "fingerprint"),
        "fingerprint",
        lambda: lambda codes: [[decode(c or "").view(np.int64).tolist() for c in codes]],
        "hashes array<bigint>",
    )
    # bigint order of the hash with the sign bit flipped is the unsigned order
    flipped = unpack.select(*by, F.explode_outer("hashes").alias("h")).withColumn("h", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    lowest = flipped.distinct().withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("h").asc_nulls_last()))).where(F.col("at") <= k)
    lists = lowest.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [np.array(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in batch.column("hashes").to_pylist()]
            columns = [batch.column(name) for name in by] + [pa.array([encode(s) for s in sketches], pa.string()), pa.array([distinct_shingles(s, k) for s in sketches], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "fingerprint", "distinct_shingles"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema if f.name in by), "fingerprint string", "distinct_shingles double"])
    return lists.mapInArrow(run, schema)


_PAIR_FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, edited_in_next double"


def with_neighbours(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Sketch every document, its edited text, and compare with the next document, in id order.

    The edited text has its last n_chars // 2 characters replaced by the first as many of the next
    document. The order is that of (doc_id, text), null ids first; behind the last comes the first. Documents go to ranges of ids (bounds
    from quantiles; their number follows the shuffle partitions), and the first document of each range is also sent, as a
    look-ahead, to the range before. So texts cross one shuffle and are read in order, one at a time. Repeated
    rows are each other's neighbours; a single document is its own neighbour. Null texts are empty. An empty table gives no row.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = [i / buckets for i in range(1, buckets)]
    bounds = sorted({int(x) for x in rows.where("doc_id is not null").stat.approxQuantile("doc_id", inner, min(0.01, 0.2 / buckets))}) if inner else []
    # one row for each range: the ids that begin a range are a list as long as the bounds
    heads = {r.bucket: r.head for r in _dealt(rows.select("doc_id", F.lit("").alias("text")), bounds, {}).groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("head")).collect()}
    present = sorted(heads)
    before = {heads[b]: present[i - 1] for i, b in enumerate(present)}
    # an id may be repeated: only the first of its rows is looked at, and it sorts first
    ordered = _dealt(rows, bounds, before).repartition(max(1, buckets // 4), "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_sketch, closed, out = None, None, None, []
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for row in whole.slice(at, SLICE).to_pylist():
                    if row["ahead"] and closed == row["bucket"]:
                        continue
                    text = row["text"] or ""
                    its = sketch(text)
                    if held is not None:
                        out.append(_compare(held["doc_id"], held["text"] or "", held_sketch, text, its))
                    if row["ahead"]:
                        held, closed = None, row["bucket"]
                    else:
                        held, held_sketch = row, its
                    if len(out) >= SLICE:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    return ordered.mapInArrow(run, _PAIR_FIELDS)


#: Where rows without an id stand in the order.
_NO_ID = -(1 << 63)


def _dealt(rows: DataFrame, bounds: list[int], before: dict[int, int]) -> DataFrame:
    """Rows with the range of their id, and once more, as look-ahead, those that begin the next range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "bucket", "ahead"]
        for batch in batches:
            ids = [_NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            own = [bisect.bisect_right(bounds, i) for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array([False] * len(ids))], names=names)
            first = [at for at, i in enumerate(ids) if i in before]
            if first:
                part = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([before[ids[at]] for at in first], pa.int32()), pa.array([True] * len(first))], names=names)

    return rows.mapInArrow(run, "doc_id bigint, text string, bucket int, ahead boolean")


def _compare(doc_id: int, text: str, own: np.ndarray, next_text: str, next_sketch: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    edited_sketch = sketch(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, encode(own), encode(edited_sketch), resemblance(own, edited_sketch), resemblance(own, next_sketch), distinct_shingles(own), containment(edited_sketch, next_sketch)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    names = [part.split()[0] for part in _PAIR_FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(read_table(spark, sf_dir, "documents"))
