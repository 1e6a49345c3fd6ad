"""Language identification: nearest clustered centroid of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import fold_remainder, map_texts, read_table

#: Hashed n-gram dimensions, n-gram lengths in characters, centroids of a language.
DIMENSIONS, LENGTHS, CENTROIDS = 4096, (2, 3), 4
#: Labelled documents of each language, at most about, on which its centroids are fitted; document frequencies use all.
FIT_ROWS = 2000
#: A document is rejected if its cosine is below this share of what 99.5 % of its language's fitted documents reach,
#: times sqrt(n / FULL_GRAMS) where it has fewer n-grams: short texts lie far from every centroid by nature.
REJECT_SHARE, FULL_GRAMS = 0.4, 200

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed n-grams of a whole lower-cased text, in pieces of bounded memory. Digits and repeated white space are left out."""
    counts = np.zeros(dimensions)
    shift = np.uint64(64 - (dimensions.bit_length() - 1))
    whole = " ".join((text or "").lower().split())
    for at in range(0, len(whole), _PIECE):
        piece = f" {whole}"[max(0, at - max(LENGTHS) + 2) : at + _PIECE + 1] if at else f" {whole[:_PIECE]}"
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes = codes[(codes < 48) | (codes > 57)]
        for length in LENGTHS:
            size = len(codes) - length + 1
            if size > 0:
                h = np.full(size, length, np.uint64)
                for n in range(length):
                    h = h * np.uint64(0x100000001B3) + codes[n : n + size] * _MULTIPLIERS[n]
                counts += np.bincount((h * np.uint64(0x9E3779B97F4A7C15)) >> shift, minlength=dimensions)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector with damped term counts; zero for no n-gram."""
    vector = np.log1p(counts) * idf
    norm = np.sqrt(vector @ vector)
    return (vector / norm if norm else vector).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether that is too far to trust."""
        if not has_letter(text) or not self.languages:
            return "und", 0.0, True
        counts = gram_counts(text, len(self.idf))
        similar = self.centroids @ weighted(counts, self.idf)
        best = int(np.argmax(similar))
        cosine = float(min(1.0, max(0.0, similar[best])))
        return self.languages[best], cosine, bool(cosine < self.floors[best] * np.sqrt(min(1.0, counts.sum() / FULL_GRAMS)))


def _labelled(documents: DataFrame, learn: Column) -> DataFrame:
    return documents.where(learn).select(F.col("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")


def document_frequencies(texts: DataFrame, dimensions: int) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs: sums of one array a task, and so ``dimensions`` rows in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen[:dimensions] += gram_counts(text.as_py(), dimensions) > 0
                seen[dimensions] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1), pa.int32()), pa.array(seen)], names=["gram", "n"])

    total = np.zeros(dimensions + 1, np.int64)
    for row in texts.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[row.gram] = row.n
    return total[:dimensions], int(total[dimensions])


def cluster(vectors: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Spherical k-means: unit centroids, and the cosine to the nearest that 99.5 % of the vectors reach."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return centroids, float(np.quantile((vectors @ centroids.T).max(axis=1), 0.005))


def fit(documents: DataFrame, learn: Column | None = None, dimensions: int = DIMENSIONS, centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS, reject_share: float = REJECT_SHARE) -> Model:
    """Learn from the rows where ``learn`` holds and text and lang are not null.

    Document frequencies are counted over all of them. The centroids of a language come from about ``fit_rows`` of its
    distinct texts (all, where it has no more), chosen by a hash of the text, in one task for each language; so neither a task nor the driver holds more than that. The number of languages has to fit the
    driver. Texts without a letter teach nothing. Without any labelled row every prediction is `und`.
    """
    rows = _labelled(documents, F.lit(True) if learn is None else learn)
    frequency, total = document_frequencies(rows, dimensions)
    idf = np.log((1 + total) / (1 + frequency)) + 0.1
    # copies are one text: the share follows the distinct texts of a language, not its rows
    texts = rows.select("lang", F.xxhash64("text", F.lit(1)).alias("h")).distinct()
    sizes = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(idf, [], np.zeros((0, dimensions), np.float32), np.zeros(0))
    shares = documents.sparkSession.createDataFrame([(lang, int(min(1.0, fit_rows / n) * (1 << 30))) for lang, n in sizes.items()], "lang string, below bigint")
    sample = rows.join(F.broadcast(shares) if len(sizes) < 10_000 else shares, "lang").where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < F.col("below")).select("lang", "text").distinct()
    # copies hash alike, so they are chosen together: as one text, however many they are

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # in the order of their hashes: the first centroids, and so the model, do not depend on the order of the shuffle
        made = {xxhash.xxh64_intdigest(t.encode()): weighted(gram_counts(t, dimensions), idf) for frame in frames for t in frame["text"] if has_letter(t)}
        vectors = [made[h] for h in sorted(made) if made[h].any()]
        if vectors:
            found, floor = cluster(np.stack(vectors), centroids)
            yield pd.DataFrame({"lang": key[0], "centroid": [c.tolist() for c in found], "floor": floor * reject_share})

    learned = sample.groupBy("lang").applyInPandas(run, "lang string, centroid array<float>, floor double").collect()
    learned = sorted(learned, key=lambda r: (r.lang, r.centroid))
    return Model(idf, [r.lang for r in learned], np.array([r.centroid for r in learned], np.float32).reshape(-1, dimensions), np.array([r.floor for r in learned]))


def with_language(documents: DataFrame, model: Model) -> DataFrame:
    """Append lang_pred, score (cosine to the nearest centroid, 0 to 1) and lang_rejected. Other columns stay.

    A text that is null or has no letter is `und`, score 0 and rejected. A text that is too far from every centroid keeps its nearest language and is
    rejected. Repeated rows get the same; an empty table gives no row.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [list(x) for x in zip(*map(shipped.value.predict, texts))]

    return map_texts(documents, "text", make, "lang_pred string, score double, lang_rejected boolean")


def learn_fold() -> Column:
    return fold_remainder("doc_id", 3) != 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = fit(documents, learn_fold())
    rows = documents.select("doc_id", "text", (~learn_fold()).alias("held_out"))
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")
