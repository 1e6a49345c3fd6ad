"""Mixing sources to target weights: a splitting tree over exact block quotas."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import materialize, read_table

#: Weights in the order of the sources, repeating; how often a document may be used; output shards.
WEIGHTS, MOST_USES, SHARDS = (1, 2, 3), 3, 64
#: Rows of a block at least, and blocks of all sources together: blocks hold about as many words whatever their source.
BLOCK_ROWS, MOST_BLOCKS = 64, 65536
_SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_SPACE)), F.lit(0)).cast("bigint")


def row_hash(seed: int) -> Column:
    """Hash of a row; it also tells which columns are null, as the hash passes over those."""
    names = ["doc_id", "source", "text"]
    return F.xxhash64(*names, *[F.isnull(name) for name in names], F.lit(seed))


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight; a share stops at ``most`` times its size and the excess is shared again."""
    targets, open_ = [0.0] * len(sizes), [at for at, size in enumerate(sizes) if size > 0]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[at] for at in open_)
        full = [at for at in open_ if left * weights[at] / total > most * sizes[at]]
        if not full:
            for at in open_:
                targets[at] = left * weights[at] / total
            break
        for at in full:
            targets[at] = float(most * sizes[at])
        left -= sum(targets[at] for at in full)
        open_ = [at for at in open_ if at not in set(full)]
    return targets


def _rng(seed: int, *path: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *path)).encode()).digest()[:8], "big"))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, as a shards x sources table whose columns sum to the quotas.

    At each node of the tree, the blocks of all sources are dealt between the left and the right shards: the left side draws its share of blocks
    without replacement, so the numbers by source are multivariate hypergeometric. Shards differ in size by one block at most.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.array(quotas, np.int64))]
    while stack:
        low, high, counts = stack.pop()
        if high - low == 1:
            out[low] = counts
            continue
        middle = (low + high) // 2
        total = int(counts.sum())
        # shard i of this node gets total // n blocks, and one more if i < total % n
        each, rest = divmod(total, high - low)
        draw = each * (middle - low) + min(rest, middle - low)
        # "marginals" draws source by source, so its memory does not grow with the blocks
        left = _rng(seed, low, high).multivariate_hypergeometric(counts, draw, method="marginals") if total else counts
        stack += [(low, middle, left), (middle, high, counts - left)]
    return out


@dataclass
class SourcePlan:
    source: str | None
    size: int
    target: float
    blocks: int
    step: int
    shift: int
    passes: int
    rest: float


def plan_sources(totals: list, weights: tuple, most: int, seed: int) -> list[SourcePlan]:
    """Targets and block permutations; sources in order of their code points, null last."""
    ordered = sorted(totals, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r.size or 0 for r in ordered]
    targets = water_fill(sizes, [weights[at % len(weights)] for at in range(len(ordered))], most)
    plans = []
    for at, (row, target) in enumerate(zip(ordered, targets)):
        blocks = max(1, min(row.rows // BLOCK_ROWS, MOST_BLOCKS * sizes[at] // max(1, sum(sizes))))
        rng = _rng(seed, "permutation", at)
        step = next(int(s) for s in rng.integers(1, blocks + 1, 1000) if math.gcd(int(s), blocks) == 1)
        passes = int(target // sizes[at]) if sizes[at] else 0
        plans.append(SourcePlan(row.source, sizes[at], target, blocks, step, int(rng.integers(0, blocks)), passes, target - passes * sizes[at]))
    return plans


def _in_order(plans: list[SourcePlan], spark: SparkSession) -> DataFrame:
    rows = [(at, p.source, p.size, p.target, p.blocks, p.step, p.shift, p.passes) for at, p in enumerate(plans)]
    return spark.createDataFrame(rows, "src int, source string, source_size bigint, target double, blocks int, step int, shift int, passes int")


def mix_documents(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_USES, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """How often and into which shards the mix takes each document.

    Returns one row for each row of ``documents``: doc_id, source, size (words), source_size and target (of its source, in words), uses, taken
    (size times uses) and shards (one shard number for each use).

    Each source is cut into blocks by a hash of the document, and an affine permutation orders the blocks. A source is
    taken in whole passes as often as its target allows, and a last pass takes blocks in permuted order up to
    the target. The block that crosses it gives documents as long as they fit, so a source ends below its
    target by less than the smallest document that this block has left. ``split_quotas`` fixes how many blocks of each source a shard gets, and shards
    draw consecutive, so disjoint, stretches of each permutation.

    Only sums for each source and block (about MOST_BLOCKS and one for each source) are brought together; documents are never
    shuffled by source, so a source with most rows costs no more than others. The number of sources has to fit the driver. Everything follows
    from the rows and ``seed``; reruns agree. Null text: size 0. Null source: a source, the last. Rows of size 0 are part of their blocks and use 0 words. Repeated
    rows share their fate. A null id is hashed as such. Empty table: no row. Other columns are ignored.
    """
    spark = documents.sparkSession
    sized = documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), row_hash(seed).alias("h"))
    sized = materialize(sized, "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    plans = plan_sources(totals, weights, most, seed)
    known = F.broadcast(_in_order(plans, spark)) if len(plans) <= 10_000 else _in_order(plans, spark)
    at_block = F.pmod(F.pmod(F.col("h"), F.col("blocks")) * F.col("step") + F.col("shift"), F.col("blocks")).cast("int")
    placed = sized.join(known.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("turn", at_block)
    placed = placed.select("doc_id", "source", "size", "h", "src", "source_size", "target", "passes", "blocks", "turn")
    by_turn = _block_sums(placed, plans)

    # the last, partial pass: whole blocks below the rest, then documents of the block that crosses it
    cut, quotas = [], []
    for at, plan in enumerate(plans):
        running = np.cumsum(by_turn[at])
        whole = int(np.searchsorted(running, plan.rest + 1e-6, "right")) if plan.rest > 0 else 0
        whole = min(whole, plan.blocks)
        left = plan.rest - (running[whole - 1] if whole else 0)
        cut.append((at, whole, float(left) if whole < plan.blocks else 0.0))
        quotas.append(plan.passes * plan.blocks + whole + (1 if whole < plan.blocks and left > 0 else 0))
    table = split_quotas(quotas, shards, seed)
    ends = np.cumsum(table, axis=0)
    stretches = spark.createDataFrame([(at, whole, left, [int(x) for x in ends[:, at]]) for at, whole, left in cut], "src int, whole int, room double, ends array<bigint>")
    placed = placed.join(F.broadcast(stretches) if len(plans) <= 10_000 else stretches, "src")

    at_edge = (F.col("turn") == F.col("whole")) & (F.col("room") > 0)
    inside = placed.where(~at_edge).withColumn("last", (F.col("turn") < F.col("whole")).cast("int"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema), "last int"])
    decided = inside.unionByName(placed.where(at_edge).groupBy("src").applyInPandas(_fill, schema))

    uses = F.col("passes") + F.col("last")
    slots = F.transform(F.sequence(F.lit(1), uses), lambda i: (i - 1) * F.col("blocks").cast("bigint") + F.col("turn"))
    shard = F.transform(slots, lambda slot: F.size(F.filter("ends", lambda end: end <= slot)))
    return decided.select(
        "doc_id", "h", "source", "size", "source_size", "target", uses.cast("int").alias("uses"), (F.col("size") * uses).cast("bigint").alias("taken"),
        F.when(uses > 0, shard).otherwise(F.array().cast("array<int>")).alias("shards"),
    )


def _block_sums(placed: DataFrame, plans: list[SourcePlan]) -> list[np.ndarray]:
    sums = [np.zeros(plan.blocks, np.int64) for plan in plans]
    for row in placed.groupBy("src", "turn").agg(F.sum("size").alias("size")).collect():
        sums[row.src][row.turn] = row.size
    return sums


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """Documents of the crossing block, in hashed order as long as they fit, then by exchanges that leave less room.

    Repeated rows count as one document.
    """
    sizes = frame.groupby("h", sort=True)["size"].sum()
    sizes = sizes[sizes > 0]
    value, taken, room = sizes.to_numpy(), np.zeros(len(sizes), bool), frame["room"].iloc[0] + 1e-6
    for at, size in enumerate(value.tolist()):
        if size <= room:
            taken[at] = True
            room -= size
    for _ in range(8):
        ins, outs = np.flatnonzero(~taken), np.flatnonzero(taken)
        if not len(ins) or not len(outs) or room < 1:
            break
        ins = ins[np.argsort(value[ins], kind="stable")]
        at = np.searchsorted(value[ins], value[outs] + room, "right") - 1
        gain = np.where(at >= 0, value[ins][np.maximum(at, 0)] - value[outs], 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        taken[outs[best]], taken[ins[at[best]]] = False, True
        room -= gain[best]
    return frame.assign(last=frame["h"].isin(sizes.index[taken]).astype("int32"))


def mixed_rows(documents: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: one row for each use of a document, with its columns, the shard and the place in the shard's order.

    Columns of the documents that are named like new ones (shard, place, use) are replaced. Sorting a shard by place shuffles it
    locally.
    """
    plan = mix_documents(documents, seed=seed, **options).select("h", "shards").dropDuplicates(["h"])
    uses = plan.select(F.col("h").alias("__h"), F.posexplode("shards").alias("use", "shard"))
    own = documents.drop("shard", "place", "use").withColumn("__key", row_hash(seed))
    return own.join(uses, F.col("__key") == F.col("__h")).withColumn("place", F.xxhash64("__key", "use")).drop("__key", "__h")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "uses", "shards")
