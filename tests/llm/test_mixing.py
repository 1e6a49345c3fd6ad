import numpy as np
import pytest

from dbgauge.llm.mixing import mix_documents, mixed_rows, op10_mixing, split_quotas, water_fill

SCHEMA = "doc_id bigint, text string, source string, size string, h int, shard int"


def plain_targets(sizes):
    """By steps: sizes in source order; weights 1, 2, 3 repeating; at most 3 times the size."""
    weights = [1 + at % 3 for at in range(len(sizes))]
    full = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[at] for at in full)
        total = sum(w for at, w in enumerate(weights) if at not in full)
        targets = [3 * s if at in full else left * weights[at] / total for at, s in enumerate(sizes)]
        over = {at for at, t in enumerate(targets) if at not in full and t > 3 * sizes[at]}
        if not over:
            return targets
        full |= over


def check(rows, got, tolerance=None):
    by = {}
    for _, text, source in rows:
        by.setdefault(source, []).append(len((text or "").encode().split()))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, plain_targets([sum(by[s]) for s in order])))
    assert len(got) == len(rows)
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.source_size == sum(by[r.source]) and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.uses * r.size and 0 <= r.uses <= 3 and len(r.shards) == r.uses
        taken[r.source] += r.taken
    for source in order:
        sizes = [r.size for r in got if r.source == source and r.size]
        assert taken[source] <= targets[source] + 1e-3
        if sizes and (tolerance or 0) is not None:
            assert targets[source] - taken[source] <= max(tolerance or 0, max(sizes))


def test_targets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [int(x) for x in rng.integers(1, 10 ** int(rng.integers(1, 6)), int(rng.integers(1, 9)))]
        assert water_fill(sizes, [1 + at % 3 for at in range(len(sizes))], 3) == pytest.approx(plain_targets(sizes))
    assert water_fill([0, 10], [1, 2], 3) == [0, 10] and water_fill([], [], 3) == []


def test_quotas_are_exact_and_even():
    quotas = [1000, 1, 0, 37, 12345]
    for shards in (1, 2, 7, 64):
        table = split_quotas(quotas, shards, 5)
        assert table.sum(axis=0).tolist() == quotas
        assert table.sum(axis=1).max() - table.sum(axis=1).min() <= 1
        assert (table == split_quotas(quotas, shards, 5)).all()
    assert (split_quotas(quotas, 7, 5) != split_quotas(quotas, 7, 6)).any()


def test_mix_of_skewed_sources(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{min(int(rng.exponential(2)), 7)}") for i in range(6000)]
    frame = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)
    got = mix_documents(frame, shards=8).collect()
    check(rows, got)
    again = {r.doc_id: r.shards for r in mix_documents(frame.repartition(5), shards=8).collect()}
    assert again == {r.doc_id: r.shards for r in got}
    out = mixed_rows(frame, shards=8).collect()
    assert sorted((r.doc_id, r.shard) for r in out) == sorted((r.doc_id, s) for r in got for s in r.shards)
    shard_rows = [sum(1 for r in out if r.shard == s) for s in range(8)]
    assert max(shard_rows) < 2 * min(shard_rows)


def test_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "x\ty\x0bz", "b"), (5, "word " * 30000, "b"), (6, "a", "a"), (7, "b b", "a")]
    frame = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)
    check(rows, mix_documents(frame).collect())
    assert {"doc_id", "text", "source", "size", "h", "shard", "place", "use"} == set(mixed_rows(frame).columns)
    mixed_rows(frame).collect()
    assert mix_documents(frame.limit(0)).count() == 0 and mixed_rows(frame.limit(0)).count() == 0
    assert mix_documents(frame.where("doc_id = 2")).first().taken == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op10_mixing(spark, sf).collect()
    check(rows, got)
    for source in {r.source for r in got}:
        taken = sum(r.taken for r in got if r.source == source)
        target = next(r.target for r in got if r.source == source)
        assert abs(taken - target) < 0.005 * target


def test_rows_that_differ_by_which_column_is_null(spark):
    """Such rows are two rows, with uses of their own, in both results."""
    from collections import Counter

    from dbgauge.llm.mixing import mix_documents, mixed_rows, row_hash

    rows = [(1, None, "x"), (1, "x", None), (None, "x", "1"), *[(k, "s", f"w{k} " * (k % 7)) for k in range(2, 60)]]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert frame.select(row_hash(17)).distinct().count() == len(rows)
    uses = {(r.doc_id, r.source): r.uses for r in mix_documents(frame).collect()}
    rowed = Counter((r.doc_id, r.source) for r in mixed_rows(frame).collect())
    assert rowed == Counter({key: n for key, n in uses.items() if n})
