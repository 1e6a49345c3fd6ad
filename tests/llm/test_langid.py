import zlib

from pyspark.sql import functions as F

from dbgauge.llm.langid import fit, gram_counts, learn_fold, op8_language_id, with_language

SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred int"


def test_grams_of_pieces(monkeypatch):
    from dbgauge.llm import langid

    text = "Grüße  an\nalle 123 Leser " * 40
    whole = gram_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 50)
    assert abs(gram_counts(text).sum() - whole.sum()) <= 2 * len(text) / 50
    assert gram_counts(None).sum() == 0 == gram_counts("7").sum() - gram_counts("7").sum()


def test_edges(spark):
    rows = [(i, ("the thing that they think " if i % 2 else "und der nicht das ist ein ") * (i % 5 + 1) + str(i), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "de"), (None, "they think that", None), (103, "the thing " * 200000, None), (104, "the thing", None), (104, "the thing", None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    model = fit(frame)
    got = [(r.doc_id, r.lang_pred, r.score, r.lang_rejected) for r in with_language(frame, model).collect()]
    assert len(got) == len(rows) and all(0 <= g[2] <= 1 for g in got)
    found = {g[0]: g for g in got}
    assert all(found[i][1] == ("en" if i % 2 else "de") for i in range(60))
    assert all(found[i][1:] == ("und", 0.0, True) for i in (100, 101, 102))
    assert found[None][1] == found[103][1] == found[104][1] == "en"
    assert with_language(frame.limit(0), model).count() == 0
    nothing = fit(frame.limit(0))
    assert {r.lang_pred for r in with_language(frame, nothing).collect()} == {"und"}


def test_copies_do_not_thin_the_sample(spark):
    english = [("the thing that they think ", "en")] * 2000 + [(f"the other thing they {w} there ", "en") for w in ("had", "saw", "took")]
    rows = english + [("und der nicht das ist ein ", "de")] * 2000 + [("der andere hund ist nicht da ", "de")]
    frame = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    model = fit(frame, fit_rows=20)
    assert model.languages == ["de"] * 2 + ["en"] * 4


def test_far_texts_are_rejected(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("learn", learn_fold())
    model = fit(documents, F.col("learn"))
    texts = ["Привет, как дела сегодня вечером? " * 8, "こんにちは世界、今日はとてもいい天気ですね。" * 8, "xqzxq zzqx qqxz zqq xxz " * 12]
    strange = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert all(r.lang_rejected for r in with_language(strange, model).collect())
    assert with_language(documents, model).where("lang_rejected").count() == 0


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == set(truth) and len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
