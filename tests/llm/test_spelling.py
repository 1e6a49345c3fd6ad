import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from dbgauge.llm.spelling import Shards, hash_words, near_words, op12_spelling, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = {c: c + 32 for c in range(65, 91)}


def words_of(rows, least=6):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                found[run] += 1
    return found


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_pairs(words):
    """By words that share a form with one place blanked out or deleted; each is then compared in full."""
    groups = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            groups[w[:k] + "*" + w[k + 1 :]].add(w)
            groups[w[:k] + w[k + 1 :]].add(w)
        groups[w].add(w)
    return {(a, b) for same in groups.values() if len(same) > 1 for a in same for b in same if a != b and one_apart(a, b)}


def expected(rows, least_count=5):
    n = {w: c for w, c in words_of(rows).items() if c >= least_count}
    near = defaultdict(list)
    for a, b in near_pairs(n):
        near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(frame):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]


def corpus(seed, documents=60):
    """Words at few places of a small space, so that many are near each other, with counts in chains."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("aàÿbzß÷", k=rng.randrange(6, 9))) for _ in range(12)]
    words = set(stems)
    for _ in range(120):
        w = rng.choice(sorted(words))
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aàÿbz") + w[k:], w[:k] + rng.choice("aàÿbz") + w[k + 1 :]]))
    weights = [5 ** rng.randrange(5) for _ in words]
    chain = " ".join(f"{word} " * 5**k for k, word in enumerate(["chainaaa", "chainaab", "chainabb", "chainbbb", "chainbbbb"], 1))
    return [(-1, chain), *[(k, rng.choice([" ", "-1-", "日"]).join(rng.choices(sorted(words), weights, k=400))) for k in range(documents)]]


@pytest.mark.parametrize("pass_blocks", [1, 3, 1 << 19])
def test_against_all_pairs(spark, pass_blocks):
    rows = corpus(pass_blocks)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = expected(rows)
    got = rows_of(spelling_variants(frame, pass_blocks=pass_blocks))
    assert set(got) == want and len(got) == len(want)
    assert len({root for _, form, root, *_ in want if form and root != form}) and any(k > 1 for *_, k, _ in want)


def test_edges(spark):
    schema = "doc_id bigint, text string, word int, n string, root string"
    long = "x" * 30_000
    rows = [(1, "Straße STRASSE strasse " * 5), (2, None), (3, ""), (None, "naïveté " * 6), (None, "naiveté " * 40), (4, "short words only ab cd"), (5, (long + " ") * 5),
            (5, (long[:-1] + "y ") * 30), (6, "ÀÉÎÕÜÿ àéîõüÿ " * 7), (7, "aaaaaaa aaaaaa aaaaaaaa " * 9), (1, "Straße STRASSE strasse " * 5)]
    frame = spark.createDataFrame([(*r, 1, "n", "r") for r in rows], schema)
    got = rows_of(spelling_variants(frame))
    assert set(got) == expected(rows) and len(got) == len(set(got))
    assert spelling_variants(frame.limit(0)).count() == 0 and spelling_variants(frame.where("doc_id = 4")).count() == 0


def test_filters_are_planned_by_length():
    shards = Shards.plan({6: 100, 9: 1, 7: 1000})
    assert shards.first == {6: 0, 7: 4, 9: 36} and shards.blocks == {6: 4, 7: 32, 9: 1} and shards.total == 37
    assert [length for length in (6, 7, 8, 9) if shards.within(length, 3, 5)] == [6, 7]
    import numpy as np

    letters = np.frombuffer(b"abcdefbadcfe", np.uint8).reshape(2, 6)
    hashes = hash_words(letters)
    assert hashes[0] != hashes[1] and ((shards.block_of(7, hashes) >= 4) & (shards.block_of(7, hashes) < 36)).all()


def test_near_words_both_ways(spark):
    vocabulary = spark.createDataFrame([("abcdef", 9), ("abcdeg", 3), ("abcdefg", 7), ("zzzzzz", 5)], "word string, n bigint")
    got = {(r.word, r.near, r.near_n) for r in near_words(vocabulary).collect()}
    pairs = [("abcdef", "abcdeg"), ("abcdef", "abcdefg"), ("abcdeg", "abcdefg")]
    n = {"abcdef": 9, "abcdeg": 3, "abcdefg": 7}
    assert got == {(a, b, n[b]) for a, b in pairs} | {(b, a, n[a]) for a, b in pairs}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op12_spelling(spark, sf))
    assert set(got) == expected(docs) and len(got) == len(set(got)) > 100
