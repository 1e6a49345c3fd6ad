import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dbgauge.llm.fim import CutIndex, fill_in_middle, op11_fill_in_middle, rearrange, restored

SCHEMA = "doc_id bigint, text string, n string, form int, extra string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, unit="line", percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cut_index():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices("ab\néж日😀", k=rng.randrange(40)))
        index = CutIndex(np.frombuffer(text.encode(), np.uint8))
        chars = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in chars])
        assert index.n_chars == len(text)
        assert index.to_bytes(chars).tolist() == places.tolist() and index.to_chars(places).tolist() == chars.tolist()
    assert not len(CutIndex(np.frombuffer(b"plain ascii", np.uint8)).bytes_at)


ROWS = [
    (1, "a\nb\nc\nd"), (2, None), (3, ""), (4, "\n\n\n"), (5, "é日\n😀\r\nx"), (6, "one line"), (7, "has <S> inside\nx"), (None, "no id\nat all\n"),
    (1, "a\nb\nc\nd"), (8, "long line " * 200_000 + "\nend"), (9, "> <\n<P\nP>\n<"), *[(100 + k, "ж\n" * k) for k in range(40)],
]


@pytest.mark.parametrize("unit,percent", [("line", 100), ("char", 100), ("line", 50)])
def test_edges(spark, unit, percent):
    documents = spark.createDataFrame([(*r, "old", 1, "kept") for r in ROWS], SCHEMA)
    made = fill_in_middle(documents, unit=unit, fim_percent=percent).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted([(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made], key=str)
    assert got == sorted([(str(i), *expected(i, t, unit, percent), t or "") for i, t in ROWS], key=str)
    assert {r.extra for r in made} == {"kept"}
    assert fill_in_middle(documents.limit(0)).count() == 0
    if percent == 50:
        assert {r.form for r in made if r.n > 0 and r.doc_id != 7} == {"plain", "psm", "spm"}


def test_other_sentinels(spark):
    marks = ("[prefix]", "[suffix]", "[middle]")
    documents = spark.createDataFrame([(k, "x]\n[mid\ny[\n" * k) for k in range(1, 30)], "doc_id bigint, text string")
    made = fill_in_middle(documents, sentinels=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text and r.form != "plain" for r in made)
    for bad in (("<a>", "<a>", "<b>"), ("ab", "bc", "x"), ("", "a", "b"), ("abab", "c", "d")):
        with pytest.raises(ValueError):
            fill_in_middle(documents, sentinels=bad)
    with pytest.raises(ValueError):
        fill_in_middle(documents, unit="page")
    assert rearrange("abc", (0, 5, 0, 99), sentinels=marks) == (1, "psm", 0, 3, "[prefix][suffix][middle]abc")


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (n, form, p, m, sha(out), sha(t or "")) for d, t in docs for n, form, p, m, out in [expected(d, t)]}
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in op11_fill_in_middle(spark, sf).collect()}
    assert got == want and len(got) == len(docs)
