"""What several operators share: written tables, text mapping in Arrow batches, vectorised hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dbgauge.session import scratch_path

#: Rows of an Arrow batch that are turned into Python texts at a time.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame below the shared folder and read it again.

    This cuts the lineage, survives lost executors, and makes the frame a plain scan, so that a join
    on it is an exchange whose hot partitions Spark can split.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fold_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def map_texts(
    frame: DataFrame,
    text: str,
    make: Callable[[], Callable[[list[str | None]], list[list]]],
    fields: str,
    cells: Callable[[pa.Array], list] = pa.Array.to_pylist,
) -> DataFrame:
    """Append columns computed from a text column, in Arrow batches and without a shuffle.

    ``make`` runs once in each task and returns a function from texts to one list per new field.
    An input column with the name of a new field is replaced. ``cells`` turns a part of the column into Python values.
    """
    new = StructType.fromDDL(fields)
    kept = [name for name in frame.columns if name not in new.names or name == text]
    narrowed = frame.select(*kept)
    names = [name for name in kept if name not in new.names]
    schema = StructType([narrowed.schema[name] for name in names] + new.fields)
    arrow_new = [to_arrow_schema(StructType([field])).field(0).type for field in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                made = compute(cells(part.column(text)))
                columns = [part.column(name) for name in names]
                columns += [pa.array(values, kind) for values, kind in zip(made, arrow_new)]
                yield pa.RecordBatch.from_arrays(columns, names=names + new.names)

    return narrowed.mapInArrow(run, schema)


# ---- hashing over byte arrays: 64-bit arithmetic that wraps, no loop over words

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(size, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes; one more entry than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("base", _BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal bytes give equal hashes, wherever they stand."""
    inverse = _power_table("inverse", _INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a text, and where its words start and end."""
    raw = (text or "").lower().encode()
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = WORD_BYTES[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return raw, edges[0::2], edges[1::2]


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; a text of fewer words (but some) is one shingle."""
    raw, starts, ends = words_of(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = range_hashes(prefix_hashes(np.frombuffer(raw, np.uint8)), starts, ends)
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.zeros(count, np.uint64)
    for at in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[at : at + count]
    return mix(out)
