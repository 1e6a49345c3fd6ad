"""Repeated byte strings: a logarithmic family of sparse suffix indexes, and exact coverage of what repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import SLICE, materialize, mix, prefix_hashes, range_hashes, read_table

#: Bytes of a string that counts as repeated, and batches the documents arrive in.
LENGTH, BATCHES = 400, 4
#: Bytes of a document that are hashed at a time.
_SEGMENT = 1 << 19
_TIE = np.uint64((1 << 20) - 1)
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Shape:
    """Sizes: of repeated strings, of the suffix prefixes that are indexed, of groups of neighbouring strings."""

    length: int = LENGTH
    gram: int = LENGTH * 8 // 25
    block: int = LENGTH // 25
    #: Bytes of a document that are hashed at a time: no fewer than length + block.
    segment: int = _SEGMENT

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


class Hasher:
    """Hashes of byte ranges of one text, each shorter than a segment."""

    def __init__(self, data: bytes, segment: int = _SEGMENT):
        self.data, self.segment, self.at, self.prefix = np.frombuffer(data, np.uint8), segment, -1, None

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for segment in np.unique(starts // self.segment).tolist():
            base = segment * self.segment
            if segment != self.at:
                self.at, self.prefix = segment, prefix_hashes(self.data[base : base + 2 * self.segment])
            own = starts // self.segment == segment
            out[own] = range_hashes(self.prefix, starts[own] - base, ends[own] - base)
        return out


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from minima from both ends of fixed blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 128 bits of the SHA-256 of each byte range, as two columns: what takes bytes away is decided by these.

    The polynomial hashes only narrow down; different texts with equal ones can be written at will.
    """
    joined = b"".join(hashlib.sha256(data[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(joined, np.int64).reshape(-1, 4)[:, :2]


def sampled_suffixes(data: bytes, shape: Shape) -> tuple[np.ndarray, ...]:
    """The suffixes of a text that are indexed: (place, low, high, key, span), span of two columns.

    Each string of ``length`` bytes is assigned to the suffix, among those that begin in it and have ``gram`` bytes in it, whose hashed prefix is smallest (the
    last of equal ones). Equal strings so choose the same suffix of theirs. ``low`` to ``high`` are the starts of the strings that chose
    ``place``, ``key`` is the hash of the suffix's first ``gram`` bytes, and ``span`` the digest of all bytes of these strings.
    A place is one row, also where strings of several segments chose it: a second row would count as a second occurrence.
    """
    found = []
    for at in range(0, max(0, len(data) - shape.length + 1), shape.segment):
        part = data[at : at + shape.segment + shape.length - 1]
        prefix = prefix_hashes(np.frombuffer(part, np.uint8))
        places = np.arange(len(part) - shape.gram + 1)
        grams = range_hashes(prefix, places, places + shape.gram)
        chosen = _sliding_minimum((grams & ~_TIE) | (_TIE - places.astype(np.uint64)), shape.window) & _TIE
        chosen = (_TIE - chosen).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        place = chosen[first]
        found.append((place + at, first + at, last + at, grams[place].view(np.int64)))
    if not found:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, 2), np.int64)
    place, low, high, key = (np.concatenate(column) for column in zip(*found))
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    place, low, high, key = place[first], low[first], high[last], key[first]
    return place, low, high, key, _digests(data, low, high + shape.length)


def _suffix_rows(shape: Shape) -> Callable[[dict], list[np.ndarray] | None]:
    def make(row: dict) -> list[np.ndarray] | None:
        *columns, span = sampled_suffixes(row["text"].encode(), shape)
        return [*columns, *span.T]

    return make


def _table(frame: DataFrame, make: Callable[[dict], list[np.ndarray] | None], fields: str) -> DataFrame:
    """Rows of (id, h, *fields) that a function makes, as columns, from each row."""
    names = ["id", "h", *[part.split()[0] for part in fields.split(", ")]]
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    types = [pa.int64(), pa.int64(), *[kinds[part.split()[1]] for part in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                parts = []
                for row in whole.slice(at, SLICE).to_pylist():
                    made = make(row)
                    if made is not None and len(made[0]):
                        parts.append([np.full(len(made[0]), row["id"]), np.full(len(made[0]), row["h"]), *made])
                if parts:
                    columns = [np.concatenate(column) for column in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) if t != pa.int32() else pa.array(c.astype(np.int32)) for c, t in zip(columns, types)], names=names)

    return frame.mapInArrow(run, f"id bigint, h bigint, {fields}")


# ---- the index family


class SuffixFamily:
    """Levels of suffix arrays, each a written table of (key, n) in the order of key; level i is of 2^i batches.

    The order is that of the hashed prefix of a suffix, in which suffixes with equal prefixes are neighbours as in
    lexicographic order. Adding a batch sorts it, merge-scans it against each level for keys that both have, and merges levels of equal size, so a batch
    meets a logarithmic number of tables and each key is rewritten a logarithmic number of times.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        run = materialize(suffixes.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "suffix-level")
        self.matches.append(run.where("n > 1").select("key"))
        for _, level in self.levels:
            self.matches.append(run.join(level.select("key"), "key").select("key"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            run, size = level.unionByName(run).groupBy("key").agg(F.sum("n").alias("n")), size * 2
        if size > 1:
            run = materialize(run.sortWithinPartitions("key"), "suffix-level")
        self.levels.append((size, run))

    def repeated(self) -> DataFrame:
        """Keys of suffixes that occur more than once in what was added."""
        return materialize(reduce(DataFrame.unionByName, self.matches).distinct(), "repeated-suffixes")


def _repeated(values: DataFrame, name: str) -> DataFrame:
    """Distinct rows that occur more than once, counted in each task first."""
    return materialize(values.groupBy(*values.columns).agg(F.count("*").alias("n")).where("n > 1").drop("n"), name)


# ---- exact coverage


def _block_rows(shape: Shape) -> Callable[[dict], list[np.ndarray] | None]:
    """Groups of neighbouring strings of the open suffixes of a text: (start, low, high, core, span, tail).

    Group b of a suffix has the strings that begin b * block to (b + 1) * block - 1 bytes in front of it. Their common bytes are the core: if it is unique, so is
    each of them. If all their bytes together (span and tail: the digest and b; 0 where they do not fit the text) repeat for the same b, each of them does.
    """

    def make(row: dict) -> list[np.ndarray] | None:
        open_ = [s for s in row["suffixes"] if s["open"]]
        if not open_:
            return None
        data = (row["text"] or "").encode()
        place, low, high, key = (np.array([s[name] for s in open_], np.int64) for name in ("place", "low", "high", "key"))
        least, most = (place - high) // shape.block, (place - low) // shape.block
        count = most - least + 1
        of = np.repeat(np.arange(len(place)), count)
        b = least[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        p = place[of]
        salt = mix(key[of].view(np.uint64) + b.astype(np.uint64))
        hasher = Hasher(data, shape.segment)
        start, end = p - b * shape.block, p - (b + 1) * shape.block + 1 + shape.length
        core = mix(hasher.ranges(start, end) ^ salt)
        start, end = p - (b + 1) * shape.block + 1, p - b * shape.block + shape.length
        fits = (start >= 0) & (end <= len(data))
        span = np.zeros((len(p), 2), np.int64)
        span[fits] = _digests(data, start[fits], end[fits])
        span[fits, 1] += b[fits]
        lowest = np.maximum(low[of], p - (b + 1) * shape.block + 1)
        highest = np.minimum(high[of], p - b * shape.block)
        return [p - (b + 1) * shape.block + 1, lowest, highest, core.view(np.int64), *span.T]

    return make


def _string_rows(shape: Shape) -> Callable[[dict], list[np.ndarray] | None]:
    def make(row: dict) -> list[np.ndarray] | None:
        starts = np.concatenate([np.arange(b["low"], b["high"] + 1) for b in row["blocks"]])
        starts = np.unique(starts)
        return [starts, *_digests((row["text"] or "").encode(), starts, starts + shape.length).T]

    return make


def remove_ranges(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """What is left, bytes removed, and the maximal removed runs of a text without the given ranges."""
    runs: list[list[int]] = []
    for start, end in sorted(ranges):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    kept, at = [], 0
    for start, end in runs:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept), sum(end - start for start, end in runs), len(runs), [tuple(r) for r in runs]


def _judge(rows: DataFrame, group: str, where: list[str]) -> DataFrame:
    """Append full (the digest in span and tail occurs more than once) and open (it has to be looked at more closely).

    Rows that are not full are open. So is one place of each repeated digest, if its ``group`` has rows that are not full: it stands for the settled ones as
    a possible partner of theirs.
    """
    whole = ["span", "tail"]
    counted = rows.where("span != 0").groupBy(*whole).agg(F.count("*").alias("n"), F.min(F.struct(*where)).alias("first")).where("n > 1").drop("n")
    marked = materialize(rows.join(materialize(counted, "repeated"), whole, "left").withColumn("full", F.col("first").isNotNull()), "marked")
    groups = materialize(marked.where("not full").select(group).distinct().withColumn("wanted", F.lit(True)), "open-groups")
    first = F.coalesce(F.struct(*where) == F.col("first"), F.lit(False))
    return marked.join(groups, group, "left").withColumn("open", ~F.col("full") | (first & F.col("wanted").isNotNull())).drop("first", "wanted")


def remove_repeats(documents: DataFrame, shape: Shape = Shape(), batches: int = BATCHES, with_kept: bool = True) -> DataFrame:
    """Cut each byte that is covered by a string of ``length`` bytes that also begins anywhere else.

    Returns, for each row of ``documents``: doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256 and, on demand, spans (array of start and end) and
    kept (binary; null where nothing was removed, the text is whole then). Strings are judged on the input, the same document counts, overlaps count, and
    nothing crosses documents. A null text is empty; texts shorter than ``length`` stay whole. Rows that repeat an id and
    text are further occurrences. Other columns are ignored; an empty table gives no row.

    1. Sampled suffixes of each text, about 2 / window of its bytes, are written; batch by batch they join the index family, which finds the
       keys that repeat. No string of another suffix repeats. 2. Suffixes whose strings all repeat as one span are settled by counting spans.
       3. The rest, at the edges of repeats, is settled by counting small groups of strings, and 4. what is still open, string by string. What is equal in 2 to 4 is told by 128 bits of SHA-256 of all bytes. All counts are
       aggregated in each task before the shuffle, and marks meet their rows in joins of two scans, so passages or copies that most documents share are
       split. Only lists that a document's own length bounds are collected.
    """
    key_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))
    rows = documents.select("doc_id", key_id.alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    scan = rows.select("id", "h", "text").where(F.octet_length("text") >= shape.length)
    suffixes = _table(scan, _suffix_rows(shape), "place int, low int, high int, key bigint, span bigint, tail bigint")
    suffixes = materialize(suffixes.withColumn("batch", F.pmod(F.xxhash64("id", "h", F.lit(9)), F.lit(batches)).cast("int")), "suffixes")

    family = SuffixFamily()
    for batch in range(batches):
        family.add(suffixes.where(F.col("batch") == batch).select("key"))
    met = materialize(suffixes.drop("batch").join(family.repeated(), "key"), "met-suffixes")
    marked = materialize(_judge(met, "key", ["id", "h", "place", "low"]), "judged-suffixes")
    lists = marked.groupBy("id", "h").agg(F.collect_set(F.struct("place", "low", "high", "key", "full", "open")).alias("suffixes"))
    concerned = materialize(scan.join(lists, ["id", "h"]), "concerned")

    blocks = _table(concerned, _block_rows(shape), "start int, low int, high int, core bigint, span bigint, tail bigint")
    blocks = materialize(blocks, "blocks")
    cores = _repeated(blocks.select("core"), "repeated-cores")
    judged = materialize(_judge(materialize(blocks.join(cores, "core"), "likely-blocks"), "core", ["id", "h", "start"]), "judged-blocks")
    open_ = judged.where("open").groupBy("id", "h").agg(F.collect_set(F.struct("low", "high")).alias("blocks"))
    texts = concerned.select("id", "h", "text")
    strings = materialize(_table(texts.join(open_, ["id", "h"]), _string_rows(shape), "low int, span bigint, tail bigint"), "strings")
    twins = strings.join(_repeated(strings.select("span", "tail"), "repeated-strings"), ["span", "tail"])

    range_ = lambda low, high: F.struct(F.col(low).alias("low"), (F.col(high) + shape.length).alias("end"))
    fine = judged.where("full").select("id", "h", range_("low", "high").alias("r")).unionByName(twins.select("id", "h", range_("low", "low").alias("r")))
    fine = fine.groupBy("id", "h").agg(F.collect_set("r").alias("ranges"))
    cut = _cut(concerned.join(fine, ["id", "h"], "left"), shape, with_kept).dropDuplicates(["id", "h"])
    base = rows.select("doc_id", "id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole_sha256"))
    out = base.join(materialize(cut, "cut"), ["id", "h"], "left").withColumns({
        "n_removed": F.coalesce("n_removed", F.lit(0)),
        "n_spans": F.coalesce("n_spans", F.lit(0)),
        "kept_sha256": F.coalesce("kept_sha256", "whole_sha256"),
    })
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_kept else []))


def _cut(frame: DataFrame, shape: Shape, with_kept: bool) -> DataFrame:
    names = ["id", "h", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_kept else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                out = []
                for row in whole.slice(at, SLICE).to_pylist():
                    ranges = [(s["low"], s["high"] + shape.length) for s in row["suffixes"] if s["full"]]
                    ranges += [(r["low"], r["end"]) for r in row["ranges"] or []]
                    if ranges:
                        kept, removed, spans, runs = remove_ranges(row["text"].encode(), ranges)
                        out.append((row["id"], row["h"], removed, spans, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept)[: len(names)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    fields = "id bigint, h bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return frame.mapInArrow(run, fields + (", spans array<struct<start:bigint,end:bigint>>, kept binary" if with_kept else ""))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_kept=False)
