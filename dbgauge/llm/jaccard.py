"""Links between texts whose sets of word shingles are alike: banded MinHash finds candidates, the sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbgauge.llm.common import materialize, mix, shingle_hashes

#: Words of a shingle, and the least Jaccard similarity of a link.
WIDTH, LEAST = 5, 0.8
#: Two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.99 at 0.8, 0.9998 at 0.9.
BANDS, ROWS = 12, 5
_STEP = 4096
_FACTORS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, BANDS * ROWS, 1)
_FACTORS[0] |= np.uint64(1)


def bands(text: str | None) -> list[int]:
    """One signed 64-bit value for each band of the text's MinHash; none for a text without words. Texts are read whole."""
    hashes = np.unique(shingle_hashes(text, WIDTH))
    if not len(hashes):
        return []
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        lowest = np.minimum(lowest, (_FACTORS[0] * hashes[at : at + _STEP] + _FACTORS[1]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for value in lowest.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + value)
    return out.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct shingle hashes."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def candidate_links(banded: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, to be compared: each node of ``banded`` (node bigint, bands array<bigint>) and one other of each of its buckets.

    A bucket is a value of a band; all of it are paired with the node that comes first in an order of the band's own, so
    pairs are no more than nodes times BANDS, however large a bucket is, and two nodes that a bucket's first keeps apart meet by another
    one. The first is an aggregate combined in each task; members meet it in a join that Spark can split. Nodes without bands have no pair.
    """
    members = materialize(banded.select("node", F.explode("bands").alias("bucket")), "band-members")
    order = F.struct(F.xxhash64("node", "bucket").alias("rank"), F.col("node").alias("node"))
    firsts = members.groupBy("bucket").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("first.node").alias("hub"))
    pairs = members.join(firsts, "bucket").where("node <> hub")
    return pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def confirmed_links(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Those pairs (a, b) whose texts have a Jaccard similarity of at least ``least``; ``texts`` has one row (node, text) for each node."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            keep = []
            for at in range(batch.num_rows):
                one, two = batch.column("text_a")[at].as_py(), batch.column("text_b")[at].as_py()
                if two != last:  # pairs of one hub follow each other
                    last, other = two, np.unique(shingle_hashes(two, WIDTH))
                keep.append(similarity(np.unique(shingle_hashes(one, WIDTH)), other) >= least - 1e-12)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")
