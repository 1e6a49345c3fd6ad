import hashlib

import numpy as np

from dbgauge.llm.sketches import containment, decode, distinct_shingles, encode, merge, merge_sketches, op2_fingerprints, resemblance, sketch, with_neighbours, with_sketch

SCHEMA = "doc_id bigint, text string, fingerprint int, bucket string, ahead string"


def shingles(text):
    words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "").lower()).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def words(low, high):
    return " ".join(f"w{i}" for i in range(low, high))


def test_estimates():
    a, b = words(0, 4000), words(1000, 6000)
    sa, sb = sketch(a), sketch(b)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(resemblance(sa, sb) - true) < 0.15
    assert abs(containment(sa, sb) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.2
    assert abs(distinct_shingles(sa) / len(shingles(a)) - 1) < 0.3
    assert distinct_shingles(sketch(words(0, 50))) == 46
    assert (merge(sketch(a), sketch(b)) == merge(sketch(b), sketch(a))).all()
    assert (decode(encode(sa)) == sa).all() and encode(sketch(None)) == ""
    assert resemblance(sketch(""), sketch(None)) == 1 and resemblance(sketch(""), sa) == 0 and resemblance(sa, sa) == 1
    assert resemblance(sketch("one Two"), sketch("ONE, two!")) == 1


def test_merge_over_parts(spark):
    parts = [("a", words(0, 900)), ("a", words(900, 2000)), ("a", None), (None, "x"), ("b", "")]
    frame = with_sketch(spark.createDataFrame(parts, "k string, text string"))
    got = {r.k: r.fingerprint for r in merge_sketches(frame, ["k"]).collect()}
    assert got == {"a": encode(merge(sketch(words(0, 900)), sketch(words(900, 2000)))), None: encode(sketch("x")), "b": ""}


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for at, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(sketch(text)), encode(sketch(edited)), resemblance(sketch(text), sketch(edited)), resemblance(sketch(text), sketch(after))))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, [tuple(r)[:7] for r in got])) == sorted(map(key, want))
    return want


def test_edges(spark):
    rows = [(5, "é" * 9), (5, "same id, other text"), (5, "é" * 9), (None, "no id"), (-3, None), (900, ""), (7, "long " * 40000), (8, "tail of it all")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    for buckets in (1, 3, 40):
        check(rows, with_neighbours(frame, buckets).collect())
    check(rows[:1], with_neighbours(frame.limit(1)).collect())
    assert with_neighbours(frame.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op2_fingerprints(spark, sf).collect()
    want = check(rows, got)
    order = sorted(rows)
    errors = []
    for at, (_, text) in enumerate(order):
        a, b = shingles(text), shingles(order[(at + 1) % len(order)][1])
        errors.append(abs(want[at][6] - (len(a & b) / len(a | b) if a | b else 1)))
    assert np.max(errors) < 0.1
