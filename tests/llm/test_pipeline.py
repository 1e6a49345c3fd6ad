from test_decontaminate import brute
from test_linededup import plain as plain_lines
from test_mixing import plain_targets
from test_simhash import plain_alike

import corpus_pipeline
from dbgauge.llm.common import materialize


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, as the pipeline runs them."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, benchmark = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, sf), name)
        rows = done.collect()
        if name == "language_id":
            assert {r.doc_id for r in rows} <= set(before) and all(any(map(str.isalpha, r.text)) for r in rows)
            assert len(rows) >= 0.99 * sum(any(map(str.isalpha, r.text or "")) for r in before.values())
        elif name == "line_dedup":
            assert sorted([(r.doc_id, r.text) for r in rows], key=str) == sorted([w[:2] for w in plain_lines([(i, r.text) for i, r in before.items()])], key=str)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            groups = plain_alike({i: r.text for i, r in before.items()})
            assert sorted(r.doc_id for r in rows) == sorted(set(groups.values()))
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == set(before) - {w[0] for w in brute([(i, r.text) for i, r in before.items()], benchmark)}
        else:
            sizes = {}
            for r in before.values():
                sizes.setdefault(r.source, {})[r.doc_id] = len(r.text.encode().split())
            order = sorted(sizes)
            for source, target in zip(order, plain_targets([sum(sizes[s].values()) for s in order])):
                taken = sum(sizes[source][r.doc_id] for r in rows if r.source == source)
                assert taken <= target + 1e-3 and target - taken <= max(sizes[source].values())
            assert set(columns) <= set(done.columns)
            break
        assert done.columns == columns and all(rows)
        docs, before = done, {r.doc_id: r for r in rows}
        assert len(before) == len(rows)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "shard", "place", "use"} <= set(out.columns) and out.count() > 50


def test_near_dedup_keeps_texts_that_share_an_id_or_have_none(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (4, text(4)), (4, text(5)), (6, text(5)), (2, text(6)), (2, text(6)), (None, text(6)), (8, text(7)), (8, text(4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == [text(k) for k in range(1, 8)]
    assert {r.text: r.doc_id for r in kept} == dict(zip(map(text, range(1, 8)), [None, None, None, 4, 4, 2, 8]))


def test_stages_return_the_columns_they_got(spark):
    """Columns named like results of the operators, a null id, null and empty texts, repeated rows and empty tables."""
    plain = "die Sonne scheint heute\nund der Himmel ist blau\nwir gehen in den Wald\n"
    rows = [(1, plain * 2, "de"), (1, plain * 2, "de"), (2, None, None), (3, "", "de"), (None, plain + "noch eine Zeile", "de"), (4, "the sun is bright\nand we walk home today", "en")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, score string, lang_rejected string, n_lines string, matches string, __id string"
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "a", "b", "c", "d", "e") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        done = stage(spark, docs, "/root/testdata/sf0.001")
        kept = done.collect()
        assert done.columns == docs.columns and done.dtypes == docs.dtypes and kept, name
        assert {(r.score, r.lang_rejected, r.n_lines, r.matches, r["__id"]) for r in kept} == {("a", "b", "c", "d", "e")}, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.mix(spark, docs, "").count() > 0 and corpus_pipeline.mix(spark, docs.limit(0), "").count() == 0
