"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dbgauge.llm.common import map_texts, read_table, shingle_hashes, words_of

#: Share of an item's shingles that a document must hold, words of a shingle, and characters of benchmark text in one block.
THRESHOLD, WIDTH, BLOCK_CHARS = 0.8, 5, 8_000_000
_TABLE_BITS = 18


#: Scripts without spaces between words: each of their characters is a word.
_SINGLE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_NO_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_ALONE = regex.compile(f"({_SINGLE})")


def plain(text: str | None) -> str:
    """A text in which only white space and ASCII punctuation stand between words; other punctuation and spaces become a space."""
    text = text or ""
    if text.isascii():
        return text
    return _ALONE.sub(r" \1 ", _NO_WORD.sub(" ", text))


def shingle_texts(text: str, width: int = WIDTH) -> list[bytes]:
    """Of a text that went through ``plain``; fewer words than ``width`` have none."""
    raw, starts, ends = words_of(text)
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def required(size: int, threshold: float) -> int:
    return max(1, int(np.ceil(threshold * size - 1e-9)))


class SizePartition:
    """Index of the items whose number of distinct shingles is in [2^k, 2^(k+1)).

    The sketch of an item of n shingles holds its n - required(n) + 1 smallest hashes (its MinHash values under one
    permutation). A document that holds required(n) of the shingles misses at most n - required(n), so it has at least
    one value of the sketch: candidates are complete, however long the document is.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.least = min(required(len(hashes), threshold) for _, hashes in items)
        pairs = [(h, at) for at, hashes in items for h in hashes[: len(hashes) - required(len(hashes), threshold) + 1].tolist()]
        pairs.sort()
        self.keys = np.array([h for h, _ in pairs], np.uint64)
        self.owners = np.array([at for _, at in pairs], np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys & np.uint64((1 << _TABLE_BITS) - 1)] = True

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) < self.least:
            return np.zeros(0, np.int64)
        likely = hashes[self.table[hashes & np.uint64((1 << _TABLE_BITS) - 1)]]
        if not len(likely):
            return np.zeros(0, np.int64)
        low, high = np.searchsorted(self.keys, likely, "left"), np.searchsorted(self.keys, likely, "right")
        hit = high > low
        if not hit.any():
            return np.zeros(0, np.int64)
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low[hit], high[hit])]))


class Searcher:
    """All size partitions of one block of items."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, width: int = WIDTH):
        self.threshold, self.width = threshold, width
        self.ids = [item_id for item_id, _ in items]
        self.shingles: list[frozenset] = []
        by_size: dict[tuple[int, int], list] = {}
        for at, (_, text) in enumerate(items):
            text = plain(text)
            words = len(words_of(text)[1])
            # an item of fewer words is one shingle, as wide as it is long
            own = min(width, words)
            self.shingles.append(frozenset(shingle_texts(text, own)) if words else frozenset())
            if words:
                hashes = np.unique(shingle_hashes(text, own))
                by_size.setdefault((own, len(hashes).bit_length()), []).append((at, hashes))
        self.partitions: dict[int, list[SizePartition]] = {}
        for (own, _), part in sorted(by_size.items(), key=lambda entry: entry[0]):
            self.partitions.setdefault(own, []).append(SizePartition(part, threshold))

    def matches(self, text: str | None) -> list[dict]:
        """Items of which the text holds enough, with the exact counts."""
        text, counted = plain(text), []
        for width, partitions in self.partitions.items():
            hashes = shingle_hashes(text, width)
            found = [at for part in partitions for at in part.candidates(hashes).tolist()]
            if found:
                own = set(shingle_texts(text, width))
                counted += [(at, len(self.shingles[at] & own), len(self.shingles[at])) for at in found]
        return [{"item_id": self.ids[at], "shared": n, "size": size} for at, n, size in counted if n >= required(size, self.threshold)]


def with_matches(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Append matches: array of (item_id, shared, size), the benchmark items of which a document holds
    at least ``threshold`` of the distinct word shingles.

    Words are runs of letters and digits, lower-cased, so case, punctuation (of any script) and line breaks do not matter; in scripts without spaces each character is a
    word. An item of fewer than ``width`` words is one shingle of its own width: it has to stand in a document as it is. Null or empty texts and those without a
    word match nothing on either side; equal items each match. An item may be scattered over a document and
    documents are searched whole. Benchmark items are sent to the tasks in blocks: their text is summed first, and each block of about
    ``block_chars`` characters is one more pass in the same projection over the documents, which are neither
    shuffled nor collected. An empty table on either side gives empty arrays. Other columns stay; one named matches is replaced.
    """
    # equal rows match as one, so that repeated benchmark rows do not repeat matches
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    field = f"array<struct<item_id:{item_type},shared:int,size:int>>"
    made = documents.drop("matches")
    parts = []
    for block in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        shipped = documents.sparkSession.sparkContext.broadcast(rows)

        def make(shipped=shipped):
            searcher = Searcher(shipped.value, threshold, width)
            return lambda texts: [[searcher.matches(t) for t in texts]]

        parts.append(f"__matches_{block}")
        made = map_texts(made, "text", make, f"{parts[-1]} {field}")
    joined = F.concat(*parts) if len(parts) > 1 else F.col(parts[0])
    return made.select(*[name for name in made.columns if name not in parts], joined.alias("matches"))


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item it holds: (doc_id, item_id, shared, size, containment)."""
    found = with_matches(documents.select("doc_id", "text"), benchmark, **options)
    pairs = found.select("doc_id", F.explode("matches").alias("m"))
    return pairs.select("doc_id", "m.item_id", "m.shared", "m.size", (F.col("m.shared") / F.col("m.size")).alias("containment"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with. Null and empty texts stay."""
    kept = StructType(documents.schema.fields).names
    return with_matches(documents, benchmark, **options).where(F.size("matches") == 0).select(*kept)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Every shared shingle by a join on its text: no sketch, no size partition.
OP5_SQL = f"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL
), w AS (
  SELECT kind, id, regexp_extract_all(regexp_replace(lower(text), '({_SINGLE})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws FROM t
), b AS (
  SELECT DISTINCT id, least(len(ws), 5) AS width, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' '))) AS g
  FROM w WHERE kind = 'b' AND len(ws) > 0
), sized AS (SELECT id AS item_id, count(*) AS n FROM b GROUP BY id),
d AS (
  SELECT DISTINCT id, v.width, unnest(list_transform(range(1, len(ws) - v.width + 2), lambda i: array_to_string(ws[i:i + v.width - 1], ' '))) AS g
  FROM w, (SELECT DISTINCT width FROM b) v WHERE kind = 'd' AND len(ws) >= v.width
),
shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM d JOIN b ON d.g = b.g AND d.width = b.width GROUP BY 1, 2)
SELECT doc_id, item_id, c::INTEGER AS shared, n::INTEGER AS size, c / n AS containment
FROM shared JOIN sized USING (item_id) WHERE c >= ceil(0.8 * n - 1e-9)
"""
