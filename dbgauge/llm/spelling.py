"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits, and the common form of each."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import SLICE, materialize, mix, read_table

#: Code points a word has at least, occurrences it has at least, how much commoner a form is, and of how many marked runs one loses a code point.
LEAST_LENGTH, LEAST_COUNT, RATIO, SALT = 6, 5, 5, 199
#: Letters that words are made of; each is one byte of Latin-1.
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
#: Bits of a filter for each word; 64-byte blocks of all filters that are broadcast at once (32 MB).
BITS_A_WORD, PASS_BLOCKS = 16, 1 << 19
_BLOCK_BITS, _LANES = 512, 8

#: Words counted in a task before they are handed on, and edits made at a time.
_HELD, _EDITS = 1 << 17, 1 << 20

_LETTER_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93  # odd


def _steps(n: int) -> np.ndarray:
    """Powers of the step: what a letter's hash is multiplied with at each place."""
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


# ---- the vocabulary


def runs_of(text: str | None, least: int) -> Counter:
    """Maximal runs of letters, lower-cased from A-Z only, of at least ``least`` code points. Other characters are one byte that no run has."""
    raw = (text or "").encode("latin-1", "replace").lower()
    return Counter(re.findall(rb"[a-z\xC0-\xFF]{%d,}" % least, raw))


def words_of_text(doc_id: str, text: str | None, least: int = LEAST_LENGTH, salt: int = SALT) -> Iterator[tuple[bytes, int]]:
    """Words of a text with their counts, Latin-1; in runs that the salt marks, one code point is missing."""
    head = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs_of(text, least).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % salt == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            yield run, n


def word_counts(documents: DataFrame, least: int = LEAST_LENGTH, salt: int = SALT) -> DataFrame:
    """(word, n) of all documents: summed in each task first, in portions of bounded size, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([word.decode("latin-1") for word in held], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in words_of_text(doc_id, text, least, salt):
                        held[word] = held.get(word, 0) + n
                    if len(held) >= _HELD:
                        yield out()
        if held:
            yield out()

    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---- filters


@dataclass(frozen=True)
class Shards:
    """Where the filter of each length lies: its first block among the blocks of all lengths, and how many it has."""

    first: dict[int, int]
    blocks: dict[int, int]

    @classmethod
    def plan(cls, words: dict[int, int]) -> Shards:
        first, blocks, at = {}, {}, 0
        for length in sorted(words):
            first[length], blocks[length] = at, -(-words[length] * BITS_A_WORD // _BLOCK_BITS)
            at += blocks[length]
        return cls(first, blocks)

    @property
    def total(self) -> int:
        return sum(self.blocks.values())

    def block_of(self, length: int, hashes: np.ndarray) -> np.ndarray:
        high = mix(hashes) >> np.uint64(32)
        return ((high * np.uint64(self.blocks[length])) >> np.uint64(32)).astype(np.int64) + self.first[length]

    def within(self, length: int, low: int, high: int) -> bool:
        """Whether the filter of a length has blocks from low to high - 1."""
        return length in self.first and self.first[length] < high and self.first[length] + self.blocks[length] > low


def lane_bits(hashes: np.ndarray) -> np.ndarray:
    """Six bits for each of the eight lanes of a block."""
    return mix(hashes ^ np.uint64(0xA0761D6478BD642F))


class BloomFilter:
    """Blocks low to high - 1: eight lanes of 64 bits each, in each of which a word has one bit."""

    def __init__(self, shards: Shards, low: int, high: int, lanes: np.ndarray):
        self.shards, self.low, self.high, self.lanes = shards, low, high, lanes

    def positives(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes whose word may be there; for words of the filter's blocks that are there, always."""
        block = self.shards.block_of(length, hashes) - self.low
        left = np.flatnonzero((block >= 0) & (block < self.high - self.low))
        block, bits = block[left], lane_bits(hashes[left])
        for lane in range(_LANES):
            bit = (bits >> np.uint64(6 * lane)) & np.uint64(63)
            on = (self.lanes[block, lane] >> bit) & np.uint64(1) == 1
            left, block, bits = left[on], block[on], bits[on]
        return left


def _matrices(words: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Words of equal length as rows of letters."""
    by_length: dict[int, list[bytes]] = {}
    for word in words:
        raw = word.encode("latin-1")
        by_length.setdefault(len(raw), []).append(raw)
    for length, same in sorted(by_length.items()):
        yield length, np.frombuffer(b"".join(same), np.uint8).reshape(len(same), length)


def hash_words(letters: np.ndarray) -> np.ndarray:
    return (_LETTER_HASH[letters] * _steps(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def build_filter(vocabulary: DataFrame, shards: Shards, low: int, high: int) -> BloomFilter:
    """Blocks low to high - 1 of the filters: bits are joined by block in Spark, and at most high - low blocks come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, letters in _matrices(batch.column("word").to_pylist()):
                hashes = hash_words(letters)
                columns = [shards.block_of(length, hashes), lane_bits(hashes).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "bits"])

    lengths = [length for length in shards.first if shards.within(length, low, high)]
    marks = vocabulary.where(F.length("word").isin(lengths)).select("word").mapInArrow(run, "block bigint, bits bigint").where(F.col("block").between(low, high - 1))
    bit = [F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(bits, {6 * lane}) & 63))")).alias(f"lane{lane}") for lane in range(_LANES)]
    rows = marks.groupBy("block").agg(*bit).toArrow() if lengths else None
    lanes = np.zeros((high - low, _LANES), np.uint64)
    if rows is not None and rows.num_rows:
        at = rows.column("block").to_numpy() - low
        for lane in range(_LANES):
            lanes[at, lane] = rows.column(f"lane{lane}").to_numpy().view(np.uint64)
    return BloomFilter(shards, low, high, lanes)


# ---- edits


def _edits(letters: np.ndarray, filter_: BloomFilter) -> Iterator[tuple[int, str]]:
    """(row, edit) for each deletion, and each replacement by a later letter, that the filters may hold.

    Of two words that differ by one code point, one is a deletion of the other, or has the earlier letter where they
    differ: so each pair is made from one side only, and once.
    """
    count, length = letters.shape
    shards, low, high = filter_.shards, filter_.low, filter_.high
    steps = _steps(length)
    weighed = _LETTER_HASH[letters] * steps
    whole = weighed.sum(axis=1, dtype=np.uint64)
    if shards.within(length - 1, low, high):
        before = np.cumsum(weighed, axis=1, dtype=np.uint64) - weighed
        behind = (whole[:, None] - before - weighed) * np.uint64(pow(_STEP, -1, 1 << 64))
        new = np.ones(letters.shape, bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # within equal letters, every deletion gives the same word
        row, at = np.nonzero(new)
        for found in filter_.positives(length - 1, (before + behind)[row, at]).tolist():
            word = letters[row[found]].tobytes()
            yield int(row[found]), (word[: at[found]] + word[at[found] + 1 :]).decode("latin-1")
    if shards.within(length, low, high):
        for part in range(0, length, wide := max(1, _EDITS // (count * len(LETTERS)))):
            here = slice(part, part + wide)
            row, at, letter = np.nonzero(LETTERS > letters[:, here, None])
            at += part
            changed = _LETTER_HASH[LETTERS[letter]] - _LETTER_HASH[letters[row, at]]
            for found in filter_.positives(length, whole[row] + changed * steps[at]).tolist():
                word = bytearray(letters[row[found]].tobytes())
                word[at[found]] = LETTERS[letter[found]]
                yield int(row[found]), word.decode("latin-1")


def _candidates(vocabulary: DataFrame, filter_: BloomFilter) -> DataFrame:
    """(word, edit, n): edits of the words that the filters may hold, n of the word."""
    shards, low, high = filter_.shards, filter_.low, filter_.high
    shipped = vocabulary.sparkSession.sparkContext.broadcast(filter_)
    concerned = [length for length in shards.first if shards.within(length, low, high) or shards.within(length - 1, low, high)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            for length, letters in _matrices(counts):
                portion = max(1, _EDITS // (length * len(LETTERS)))
                for at in range(0, len(letters), portion):
                    part = letters[at : at + portion]
                    made = [(part[row].tobytes().decode("latin-1"), edit) for row, edit in _edits(part, shipped.value)]
                    if made:
                        words, edits = zip(*made)
                        columns = [pa.array(words), pa.array(edits), pa.array([counts[word] for word in words], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["word", "edit", "n"])

    return vocabulary.where(F.length("word").isin(concerned)).mapInArrow(run, "word string, edit string, n bigint")


def near_words(vocabulary: DataFrame, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(word, near, near_n): both directions of each pair of words of ``vocabulary`` (word, n) that differ by one code point.

    The filters of all lengths are one row of blocks. Each pass builds and broadcasts at most ``pass_blocks`` of them, whatever the size of the vocabulary, and
    probes the words of the lengths they concern. Only what a filter may hold is shuffled, to an equi-join with the words themselves.
    """
    lengths = vocabulary.groupBy(F.length("word").alias("length")).count().collect()
    shards = Shards.plan({row["length"]: row["count"] for row in lengths})
    links = vocabulary.sparkSession.createDataFrame([], "word string, near string, near_n bigint")
    for low in range(0, shards.total, pass_blocks):
        filter_ = build_filter(vocabulary, shards, low, min(low + pass_blocks, shards.total))
        met = _candidates(vocabulary, filter_).join(vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
        ways = F.array(
            F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
            F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
        links = links.unionByName(materialize(met.select(F.inline(ways)), "near-words"))
    return links


# ---- forms


def spelling_variants(
    documents: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, salt: int = SALT, pass_blocks: int = PASS_BLOCKS
) -> DataFrame:
    """One row for each word: word, form, root, n (occurrences), n_near (words one code point apart), form_n.

    Words are maximal runs of LETTERS, A-Z lower-cased, of at least ``least`` code points and ``least_count`` occurrences. One run in ``salt`` (by the CRC of document and
    run) loses a code point first, which plants misspellings. The form of a word is its commonest near word (ties: the smallest), if that is at
    least ``ratio`` times as common; root is the last of the forms of forms. A null text has no words, a null id is the empty text, repeated rows and ids
    count again; other columns are ignored; without words there is no row.
    """
    counted = word_counts(documents.select("doc_id", "text"), least, salt).where(F.col("n") >= least_count)
    vocabulary = materialize(counted, "vocabulary")
    none = F.lit(None)
    rows = vocabulary.select("word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n"))
    rows = rows.unionByName(near_words(vocabulary, pass_blocks).select("word", none.cast("bigint").alias("n"), "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    judged = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    judged = judged.select("word", "n", "n_near", F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    judged = materialize(judged, "forms")
    roots = _roots(judged, least_count, ratio)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(judged: DataFrame, least_count: int, ratio: int) -> DataFrame:
    """(word, root) of the words with a form. Forms are ``ratio`` times as common each time, so a chain is short; each round doubles its reach."""
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    most = judged.agg(F.max("n")).first()[0] or 1
    reach = max(1, int(math.log(max(most / max(least_count, 1), 1)) / math.log(ratio)) + 1) if ratio > 1 else 64
    for _ in range((reach - 1).bit_length()):
        roots = materialize(roots, "roots")
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(next_, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return roots


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))
