"""SimHash near-duplicates: exact pairs within a Hamming radius through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm import jaccard
from dbgauge.llm.common import map_texts, materialize, read_table
from dbgauge.llm.components import connected_components

#: Fingerprints of one shard of the tree, on average; a shard is searched by one task at a time.
SHARD_ROWS = 8192
#: Sampled fingerprints behind each shard when the tree is fitted, and the depth beyond which shards grow instead.
SAMPLE_PER_SHARD, MAX_DEPTH = 64, 14
#: Residents up to which a branch is compared directly.
LEAF = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, counting repeats; 0 without words.

    Words are runs of bytes other than white space, A-Z lower-cased. A text of fewer than ``width`` words
    is one shingle. A bit is set if it is set in over half of the XXH64 values (seed 42).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (starts + sizes)[width - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), 1 << 14):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(documents: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Append the fingerprint as a bigint (the same 64 bits, signed). A null text is an empty one."""
    return map_texts(documents, text, lambda: lambda texts: [[_signed(fingerprint(t)) for t in texts]], f"{out} bigint")


# ---- vantage-point trees
#
# Two fingerprints that differ in at most r bits differ in at most r // 2 bits in one of their halves. So there is one
# tree for each half, whose distances are those of that half and whose radius is r // 2: with a radius of 1
# in 32 bits few points lie near a boundary, where with 3 in 64 bits more than half of them do.
# A node is (vantage point, boundary): points nearer than the boundary go to the inner branch. A point is at home (a
# resident) in one leaf. It visits another branch only if the triangle bound cannot rule out a partner there. Residents
# visit from the inner to the outer branch only, since one of two partners has to go, and pairs are of two residents or of a
# visitor and a resident.


def _distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint32(vantage)).astype(np.int16)


def _halves(fps: np.ndarray, half: int) -> np.ndarray:
    return ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and boundary with even sides and few points near the boundary; None if nothing parts the points."""
    best = None
    for vantage in points[rng.integers(0, len(points), 6)]:
        counts = np.bincount(_distance(points, vantage), minlength=33)
        inner = np.cumsum(counts)[:-1] / len(points)  # share nearer than boundary 1..32
        near = np.array([counts[max(0, m - radius) : m + radius].sum() for m in range(1, 33)]) / len(points)
        side = np.minimum(inner, 1 - inner)
        cost = np.where(side >= 0.1, near + 1.5 * (0.5 - side), np.inf)
        at = int(np.argmin(cost))
        if np.isfinite(cost[at]) and (best is None or cost[at] < best[0]):
            best = (cost[at], int(vantage), at + 1)
    return best and best[1:]


def _branch(distance: np.ndarray, resident: np.ndarray, boundary: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks: who goes to the inner branch, who to the outer one, and who of the latter is still a resident there."""
    inner = distance < boundary
    to_inner = np.where(resident, inner, distance < boundary + radius)
    to_outer = distance >= boundary - radius
    return to_inner, to_outer, resident & ~inner


def build_tree(points: np.ndarray, depth: int, radius: int, seed: int = 7) -> list[tuple]:
    """Nodes (vantage, boundary, inner, outer), or (None, leaf number): a tree over a bounded sample of points."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def grow(part: np.ndarray, left: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        cut = _split(part, radius, rng) if left and len(part) >= 16 else None
        if cut is None:
            nodes[at] = (None, leaves)
            leaves += 1
            return at
        near = _distance(part, cut[0]) < cut[1]
        nodes[at] = (*cut, grow(part[near], left - 1), grow(part[~near], left - 1))
        return at

    grow(points, depth)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indexes of the points that live in or visit it, whether they live there)."""
    stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        at, rows, resident = stack.pop()
        if not len(rows):
            continue
        node = nodes[at]
        if node[0] is None:
            yield node[1], rows, resident
            continue
        to_inner, to_outer, stays = _branch(_distance(points[rows], node[0]), resident, node[1], radius)
        stack.append((node[2], rows[to_inner], resident[to_inner]))
        stack.append((node[3], rows[to_outer], stays[to_outer]))


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``count`` indexes."""
    root = np.arange(count)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def search_shard(fps: np.ndarray, resident: np.ndarray, half: int, reach: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of all links between a resident and any point of the shard.

    The search goes on down a tree of the shard's own until a branch is small, so links of a dense cluster are never
    listed as a whole: each block of comparisons is reduced to a forest at once.
    """
    radius, rng, found = reach // 2, np.random.default_rng(seed), []
    halves = _halves(fps, half)
    stack = [(np.arange(len(fps)), resident, 0)]
    while stack:
        rows, stays, depth = stack.pop()
        homes = rows[stays]
        if not len(homes) or len(rows) < 2:
            continue
        cut = _split(halves[homes[:4096]], radius, rng) if len(homes) > LEAF and depth < 40 else None
        if cut is not None:
            to_inner, to_outer, outer = _branch(_distance(halves[rows], cut[0]), stays, cut[1], radius)
            stack.append((rows[to_inner], stays[to_inner], depth + 1))
            stack.append((rows[to_outer], outer[to_outer], depth + 1))
            continue
        for at in range(0, len(homes), 512):
            block = homes[at : at + 512]
            for to in range(0, len(rows), 4096):
                other = rows[to : to + 4096]
                i, j = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[other][None, :]) <= reach)
                a, b = block[i], other[j]
                apart = a != b
                if apart.any():
                    a, b = a[apart], b[apart]
                    ids, local = np.unique(np.concatenate((a, b)), return_inverse=True)
                    root = _roots(len(ids), local[: len(a)], local[len(a) :])
                    moved = root != np.arange(len(ids))
                    found.append((ids[moved], ids[root[moved]]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def near_links(classes: DataFrame, reach: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that span every group of fingerprints within ``reach`` bits of each other.

    ``classes`` has one row per distinct fingerprint, column fp (bigint). The upper tree is fitted on a
    sample whose size is bounded (at most SAMPLE_PER_SHARD * 2^MAX_DEPTH fingerprints); every fingerprint is routed through
    it and the result is exact. Each shard returns a chain of each of its groups, never all pairs.
    """
    radius = reach // 2
    total = classes.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(total, 1) / shard_rows)))))
    share = min(1.0, SAMPLE_PER_SHARD * 2**depth / max(total, 1))
    sample = classes.where(F.pmod(F.xxhash64(F.col("fp"), F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("fp")
    points = sample.toPandas()["fp"].to_numpy(np.int64).view(np.uint64) if depth else np.zeros(1, np.uint64)
    trees = [build_tree(_halves(points, half), depth, radius) if len(points) else [(None, 0)] for half in (0, 1)]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for half, nodes in enumerate(trees):
                for leaf, rows, resident in route(nodes, _halves(fps, half), radius):
                    yield pd.DataFrame({"cell": leaf * 2 + half, "fp": fps[rows].view(np.int64), "resident": resident})

    def links(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = search_shard(fps, frame["resident"].to_numpy(bool), key[0] % 2, reach)
        ids, local = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = _roots(len(ids), local[: len(a)], local[len(a) :])
        order = np.lexsort((fps[ids].view(np.int64), root))
        chained = root[order][1:] == root[order][:-1]
        ordered = fps[ids[order]].view(np.int64)
        return pd.DataFrame({"a": ordered[1:][chained], "b": ordered[:-1][chained]})

    dealt = classes.select("fp").mapInPandas(deal, "cell int, fp bigint, resident boolean")
    return dealt.groupBy("cell").applyInPandas(links, "a bigint, b bigint")


def _rooted(printed: DataFrame, first: Column, reach: int) -> DataFrame:
    """One row of (fp, first, root) for each distinct fingerprint: an aggregate of its rows, and the name of its group."""
    classes = materialize(printed.groupBy("fp").agg(first.alias("first")), "classes")
    roots = connected_components(near_links(classes, reach)).withColumnRenamed("node", "fp")
    return materialize(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def first_of_groups(documents: DataFrame, reach: int = 3) -> DataFrame:
    """The rows of ``documents`` that come first, by (doc_id, hash of the row), in their near-duplicate group: one of each group.

    A null id comes behind all others. Rows that share an id, or have none, are rows of their own; of wholly equal rows one is kept.
    """
    # nulls are skipped by the hash, so it is told which columns are null
    row = F.xxhash64(*[value for name in documents.columns for value in (F.col(name).isNull(), F.col(name))])
    rows = documents.withColumn("__row", row)
    printed = materialize(with_fingerprint(rows.select("doc_id", "__row", "text")).select("doc_id", "__row", "fp"), "fingerprints")
    rooted = _rooted(printed, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")), reach)
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.__row").alias("__first"))
    kept = rows.join(materialize(first, "survivors"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).select(*documents.columns)


def first_of_alike(documents: DataFrame, reach: int = 3, least: float = jaccard.LEAST) -> DataFrame:
    """``first_of_groups`` with wider groups: fingerprints also link if their first texts share at least ``least`` of their five-word shingles.

    Two texts of that similarity differ in about 10 of 64 bits, where a tree can prune nothing. So trees find the links within ``reach``, banded
    MinHash those of similar texts (99 % of them at 0.8, more above), each confirmed on the whole shingle sets, and
    groups are the components of both. Order, nulls, repeated rows and other columns are as in ``first_of_groups``; texts without a word link by fingerprint alone.
    """
    row = F.xxhash64(*[value for name in documents.columns for value in (F.col(name).isNull(), F.col(name))])
    rows = documents.withColumn("__row", row)

    def make():
        return lambda texts: [[_signed(fingerprint(t)) for t in texts], [jaccard.bands(t) for t in texts]]

    printed = map_texts(rows.select("doc_id", "__row", "text"), "text", make, "fp bigint, bands array<bigint>").select("doc_id", "__row", "fp", "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "bands"))
    classes = materialize(materialize(printed, "fingerprints").groupBy("fp").agg(first.alias("first")), "classes")
    pairs = materialize(jaccard.candidate_links(classes.select(F.col("fp").alias("node"), "first.bands")), "candidates")
    # only texts of candidates are sent on
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes, "fp").select("fp", F.col("first.doc_id").alias("__id"), F.col("first.__row").alias("__first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__first"))
    texts = materialize(rows.select("doc_id", "__row", "text").join(wanted, is_first).groupBy(F.col("fp").alias("node")).agg(F.max("text").alias("text")), "candidate-texts")
    links = near_links(classes, reach).unionByName(jaccard.confirmed_links(pairs, texts, least))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    grouped = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    survivors = materialize(grouped.select(F.col("first.doc_id").alias("__id"), F.col("first.__row").alias("__first")), "survivors")
    return rows.join(survivors, is_first, "left_semi").dropDuplicates(["doc_id", "__row"]).select(*documents.columns)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 3) -> DataFrame:
    """Near-duplicate groups: (doc_id, fp, component_id), one row for each input row.

    Documents link if their fingerprints differ in at most ``reach`` bits; component_id is the smallest
    doc_id reachable, itself included. Equal fingerprints are one class and meet as one row. Null and empty
    texts have fingerprint 0 and link like any other. Null ids are never a component_id unless a group has no other;
    repeated rows stay. Other columns are ignored, an empty table gives no row.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    printed = materialize(with_fingerprint(rows).select("doc_id", "fp"), "fingerprints")
    rooted = _rooted(printed, F.min("doc_id"), reach)
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    members = materialize(rooted.join(named, "root").select("fp", "component_id"), "members")
    return printed.join(members, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(name: str = "fp"):
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
