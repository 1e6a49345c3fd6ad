import zlib

import numpy as np

from dbgauge.llm.toxicity import LabelModel, Lexicon, fit, fit_label_model, op4_toxicity, votes, with_toxicity

SCHEMA = "doc_id bigint, text string, score string, predicted string, toxic int"


def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(1)
    truth = rng.random(8000) < 0.25
    said = lambda right, speak: np.where(rng.random(8000) < speak, np.where((rng.random(8000) < right) == truth, 1, -1), 0)
    given = np.stack([said(0.9, 0.8), said(0.75, 0.9), said(0.8, 0.7), said(0.7, 0.9), np.zeros(8000, int)], axis=1)
    given[:, 4] = given[:, 3]  # a voter that copies another
    model = fit_label_model(given, 0.25)
    assert np.abs(model.accuracies[:4] - [0.9, 0.75, 0.8, 0.7]).max() < 0.08
    assert model.correlation[3, 4] > 0.9 and abs(model.correlation[0, 1]) < 0.15
    assert ((model.posterior(given) >= 0.5) == truth).mean() > 0.87


def test_edges(spark):
    rows = [(i, ("you moron fool%d " % (i % 3) if i % 4 == 0 else "a fine day ") + "plain words here " * (i % 5), "x", "y", 1) for i in range(80)]
    rows += [(200, None, "x", "y", 1), (201, "", None, None, None), (None, "you moron", None, None, None), (202, "plain words " * 100000, "x", "y", 0), (203, "moron moron", "x", "", 0), (203, "moron moron", "x", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(4, 0), (None, 1), (900, 1), (7, None), (200, 0)], "doc_id bigint, toxic int")
    for given in (labels, labels.limit(0)):
        got = with_toxicity(frame, fit(frame, given)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        by = {r.doc_id: r.predicted for r in got}
        assert by[200] == by[201] == by[202] == 0 and by[203] == 1
    assert with_toxicity(frame.limit(0), fit(frame.limit(0), labels)).count() == 0


def test_votes():
    assert len(Lexicon().voters) == votes(np.zeros((1, 16))).shape[1]


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit / sum(truth[r.doc_id] for r in held) > 0.9 and hit / sum(r.predicted for r in held) > 0.9


def test_rare_clean_words_count_in_stems(spark):
    from dbgauge.llm.toxicity import mine_lexicon

    letters = "abcdefghijklmnopqrst"
    clean = [f"vile{a}{b} calm" for a in letters for b in letters]
    rows = [(i, "vilexa vilexb vilexc grim" if i < 60 else clean[i - 60], int(i < 60)) for i in range(60 + len(clean))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = mine_lexicon(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert "grim" in lexicon.words and "vilex" in lexicon.stems and "vile" not in lexicon.stems


def test_posterior_by_hand():
    """Two voters, one of which repeats the other: Bayes' rule with damped weights."""
    table = np.array([[[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]], [[0.6, 0.2, 0.2], [0.2, 0.3, 0.5]]])
    for correlation in (0.0, 0.8):
        model = LabelModel(0.3, table, np.array([[0, correlation], [correlation, 0]]))
        given = np.array([[a, b] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        for (a, b), got in zip(given, model.posterior(given)):
            odds = 0.3 / 0.7
            for j, vote in enumerate((a, b)):
                odds *= (table[j][1][vote + 1] / table[j][0][vote + 1]) ** (1 / (1 + correlation))
            assert abs(got - odds / (1 + odds)) < 1e-12


def test_labels_of_both_classes_are_learned_from_whatever_the_votes(spark):
    """A listed word that all texts have is no reason to fall back to fixed weights; nor are texts without any."""
    for common in ("idiot ", ""):
        rows = [(i, common + ("grim vile words " if i % 4 == 0 else "calm kind words ") * 3, int(i % 4 == 0)) for i in range(300)]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
        model = fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
        assert model.labels is not None
        scored = with_toxicity(frame.select("doc_id", "text", "toxic"), model).collect()
        assert all(r.predicted == r.toxic for r in scored)
