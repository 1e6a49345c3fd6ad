import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from dbgauge.llm.common import prefix_hashes, range_hashes
from dbgauge.llm.suffixes import Shape, op6_suffix_dedup, remove_repeats, sampled_suffixes

SCHEMA = "doc_id bigint, text string, n_bytes string, h string, key int"


def plain(rows, length):
    datas = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[at : at + length] for _, d in datas for at in range(len(d) - length + 1))
    out = []
    for doc_id, data in datas:
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if count[data[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for at, g in enumerate(gone) if g and not (at and gone[at - 1]))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def pick(rows):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], key=str)


def test_each_string_chooses_one_suffix_and_equal_strings_the_same():
    rng = random.Random(1)
    shape = Shape(12, 4, 3)
    data = "".join(rng.choices("ab", k=3000)).encode()
    place, low, high, key, span = (x.tolist() for x in sampled_suffixes(data, shape))
    starts, chosen = [], {}
    for p, a, b, k in zip(place, low, high, key):
        for at in range(a, b + 1):
            starts.append(at)
            assert at <= p <= at + shape.length - shape.gram
            assert chosen.setdefault(data[at : at + 12], (p - at, k)) == (p - at, k)
    assert starts == list(range(len(data) - 11))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_brute_force(spark, monkeypatch, seed):
    from dbgauge.llm import suffixes

    rng = random.Random(seed)
    if seed == 3:
        monkeypatch.setattr(suffixes, "_SEGMENT", 64)
    letters = "ab" if seed == 1 else "abcdefgé"
    pool = ["".join(rng.choices(letters, k=rng.randrange(8, 120))) for _ in range(25)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(rng.randrange(5))]
        text = "".join(parts)
        rows.append((i, text))
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            rows.append((1000 + i, text[:at] + "Z" + text[at + 1 :]))
    rows += rows[:3] + [(5000, "ab" * 200), (5001, None)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(4)
    got = remove_repeats(frame, Shape(24, 8, 4)).collect()
    want = plain(rows, 24)
    assert pick(got) == want and sum(w[2] for w in want) > 1000
    whole = {r.doc_id: (r.text or "").encode() for r in frame.collect()}
    for r in got:
        if r.spans:
            data, kept = whole[r.doc_id], b""
            for (_, a), (b, _) in zip([(0, 0), *r.spans], [*r.spans, (len(data), 0)]):
                kept += data[a:b]
            assert kept == bytes(r.kept)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 400), (5, "z" * 401), (None, "q" + "y" * 400), (6, "long " * 60000), (7, "one " + "w" * 10), (7, "one " + "w" * 10)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in remove_repeats(frame).collect()}
    assert got == {(1, 0): (0, 0), (2, 0): (0, 0), (3, 399): (0, 0), (4, 400): (400, 1), (5, 401): (401, 1), (None, 401): (400, 1), (6, 300000): (300000, 1), (7, 14): (0, 0)}
    assert remove_repeats(frame.limit(0)).count() == 0


def test_segments_do_not_matter(spark):
    rng = random.Random(5)
    letters = "abcdefgh"
    data = "".join(rng.choices(letters, k=3000)).encode()
    whole = [x.tolist() for x in sampled_suffixes(data, Shape(24, 8, 4))]
    assert [x.tolist() for x in sampled_suffixes(data, Shape(24, 8, 4, 64))] == whole and len(set(whole[0])) == len(whole[0])
    passage = "".join(rng.choices(letters, k=300))
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(900, 1500)))) for i in range(20)] + [(30, passage), (31, "z" * 50 + passage), (31, "z" * 50 + passage)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    want = plain(rows, 24)
    assert pick(remove_repeats(frame, Shape(24, 8, 4, 64)).collect()) == want and sum(w[2] == 0 for w in want) >= 20


def test_long_unique_text_stays(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=1_200_000)) for _ in range(4)]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    assert pick(remove_repeats(frame).collect()) == [(i, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)]


def test_texts_with_equal_polynomial_hashes_stay(spark):
    coefficients = [1]
    for step in (1, 1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32, 32, 64):  # the product of x^step - 1 is 0 modulo 2^64 at the base
        coefficients = [b - a for a, b in zip([*coefficients, *[0] * step], [*[0] * step, *coefficients])]
    one, other = ("".join(chr(40 + max(sign * c, 0)) for c in coefficients) for sign in (1, -1))
    hashes = [range_hashes(prefix_hashes(np.frombuffer(t.encode(), np.uint8)), np.array([0]), np.array([len(t)]))[0] for t in (one, other)]
    assert one != other and hashes[0] == hashes[1]
    rng = random.Random(4)
    rows = []
    for i in range(30):
        before, after = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(2))
        rows += [(2 * i, before + one + after), (2 * i + 1, before + other + after)]
    got = pick(remove_repeats(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)).collect())
    assert got == plain(rows, 400) and not any(n_removed for _, _, n_removed, _, _ in got)


def test_passages_from_the_length_on_are_caught_and_shorter_ones_stay(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randrange(2, 10))) for _ in range(3000)]
    rows, sizes = [], {}
    for i in range(60):
        passage, shared = " ".join(rng.choices(words, k=51 + i)), "\x01\x02"
        for half in (0, 1):  # different bytes on both sides, so that the shared run is the passage
            rows.append((2 * i + half, " ".join(rng.choices(words, k=100)) + shared[half] + passage + shared[half] + " ".join(rng.choices(words, k=100))))
            sizes[2 * i + half] = len(passage.encode())
    rows += [(1000 + i, " ".join(rng.choices(words, k=300))) for i in range(40)]
    got = pick(remove_repeats(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)).collect())
    assert got == plain(rows, 400)
    assert {r[0]: r[2] for r in got} == {i: size if (size := sizes.get(i, 0)) >= 400 else 0 for i, _ in rows}
    assert len({size >= 400 for size in sizes.values()}) == 2


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain(rows, 400)
    assert pick(op6_suffix_dedup(spark, sf).collect()) == want and sum(w[2] for w in want) > 0
