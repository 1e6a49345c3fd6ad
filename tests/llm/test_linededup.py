import hashlib
import random

from dbgauge.llm.linededup import dedup_lines

SCHEMA = "doc_id bigint, text string, n_chars int, n_lines string, start int, place string"


def plain(rows):
    """Line loops over (doc_id, text) rows."""

    def chunks(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        r = [(x + 31 * (h[i - 1] if i else 0)) % 2 for i, x in enumerate(h)]
        starts = [i for i in range(len(lines)) if i == 0 or i >= 2 and r[i - 1] == 0 and r[i - 2] != 0]
        return [(a, lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)])]

    may = lambda part: sum(1 for line in part if line.strip(" ")) >= 2
    order = lambda i: -(1 << 63) if i is None else i
    first = {}
    for doc_id, text in rows:
        for start, part in chunks(text) if text is not None else []:
            if may(part):
                first["\n".join(part)] = min(first.get("\n".join(part), (1 << 70, 0)), (order(doc_id), start))
    out = []
    for doc_id, text in rows:
        kept = None if text is None else [p for s, p in chunks(text) if not may(p) or first["\n".join(p)] == (order(doc_id), s)]
        removed = 0 if text is None else len(text.split("\n")) - sum(map(len, kept))
        out.append((doc_id, None if kept is None else "\n".join("\n".join(p) for p in kept), removed))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, t, 5, "x", 1, "y") for i, t in rows], SCHEMA).repartition(parts)
    got = dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "n_chars", "start", "place", "n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    got = got.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    return sorted([(r.doc_id, r.text, r.removed_lines) for r in got], key=str)


def test_random_against_line_loops(spark):
    rng = random.Random(4)
    pool = [[f"line {rng.randrange(10**6)}" for _ in range(rng.randrange(3, 14))] for _ in range(12)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(pool) if rng.random() < 0.6 else [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))]
            lines += [""] * rng.randrange(2)
        rows.append((rng.randrange(10**12) - 10**11, "\n".join(lines)))
    want = plain(rows)
    assert run(spark, rows) == want and sum(w[2] for w in want) > 100


def test_shift_resistance(spark):
    body = [f"passage line {i}" for i in range(40)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["a new line in front", *body, "and one behind"]))]
    got = run(spark, rows)
    assert got == plain(rows) and got[1][2] >= 25


def test_edges(spark):
    twice = "same one\nsame two\nsame three"
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, twice), (5, twice), (None, twice), (6, "x\ny\n" * 20000), (7, "one line"), (8, "one line")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert run(spark, []) == []


def test_shared_ids_are_documents_of_their_own(spark):
    same = "\n".join(f"passage line {i}" for i in range(30))
    rows = [(i, f"{same}\nown {j}") for i in (None, 7) for j in range(3)]
    got = run(spark, rows)
    assert sum("passage line 15" in r[1] for r in got) == 1 and all(f"own {j}" in "".join(r[1] for r in got) for j in range(3))


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a\nb", 3, "", 1, "")], SCHEMA))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
