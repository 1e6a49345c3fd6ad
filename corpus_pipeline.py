"""A corpus pipeline: each stage reads what the one before wrote, as documents, and returns documents.

Language ID drops documents in no known language, line dedup cuts repeated chunks of lines, SimHash keeps one document of each
near-duplicate group, decontamination drops documents that hold benchmark items, and mixing draws the sources to their weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm import decontaminate, langid, linededup, mixing, simhash
from dbgauge.llm.common import materialize, read_table


def _keeping(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *needed: str) -> DataFrame:
    """What an operator makes of documents, with the columns they came with.

    It sees those it needs; the others are under names it cannot replace, so a column called like one of its results (``score``, ``matches``) stays as it was.
    """
    aside = {name: f"__kept_{at}" for at, name in enumerate(docs.columns) if name not in needed}
    made = operator(docs.withColumnsRenamed(aside))
    return made.select(*[F.col(aside.get(name, name)).alias(name) for name in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; null texts and texts without a letter go.

    Repeated rows are judged alike, ties between languages go to the first, an empty table stays empty.
    """
    model = langid.fit(docs, langid.learn_fold())
    return _keeping(docs, lambda rows: langid.with_language(rows, model).where(~F.col("lang_rejected")), "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier document has. A document may become empty; null texts stay null or empty.

    Of repeated rows the first by id and hash keeps its lines. An empty table stays empty.
    """
    return _keeping(docs, linededup.dedup_lines, "doc_id", "text", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by id and hash of the row. An id may be missing or of several texts.

    Texts link by SimHash (3 of 64 bits) and by a Jaccard similarity of their five-word shingles of at least 0.8.
    Texts without a word are one group. Of repeated rows one stays; an empty table stays empty.
    """
    return _keeping(docs, simhash.first_of_alike, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows go or stay together; an empty table stays empty."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return _keeping(docs, lambda rows: decontaminate.drop_contaminated(rows, benchmark), "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each use of a document in the mix, with its shard and place."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: Language ID learns and SimHash needs XXH64, which SQL lacks; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
