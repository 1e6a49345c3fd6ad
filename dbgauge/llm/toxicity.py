"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import fold_remainder, map_texts, materialize, read_table

#: Labelled rows, at most about, on which the label model and the classifier are fitted; word statistics use all.
FIT_ROWS = 20_000
#: Words and stems of the mined lexicon, and how many voters share them.
LEXICON_WORDS, LEXICON_STEMS, WORD_VOTERS, STEM_VOTERS = 512, 128, 8, 4
#: A mined entry has been in so many toxic documents, and is so many times as frequent there as in others.
LEAST_TOXIC, LEAST_RATIO = 5, 8.0
#: A general list of insults in a few languages; mined words join it.
INSULTS = "idiot moron stupid scum trash loser clown pathetic worthless disgusting garbage imbecile dumb idiota imbécil basura estúpido crétin imbécile débile dumm blöd abschaum".split()

_WORD = re.compile(r"[^\W\d_]+")
_ADDRESSED = re.compile(r"\b(?:you|this|that|du|tu|eres|es|bist|est)\b\W+(?:\w+\W+){0,2}?$")
_SHOUT = re.compile(r"!{2,}|\?!")


@dataclass
class Lexicon:
    """Word or stem to voter. Stems are the first four or five letters of longer words."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)

    @property
    def voters(self) -> list[str]:
        named = [f"words {n}" for n in range(WORD_VOTERS)] + [f"stems {n}" for n in range(STEM_VOTERS)]
        return [*named, "insults", "several", "dense", "addressed", "shouting", "clean"]


_INSULTS = frozenset(INSULTS)


def evidence(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Counts over the whole text: a number for each lexicon voter, the fixed list, addressed hits, shouting, and all words."""
    lowered = (text or "").lower()
    out = np.zeros(WORD_VOTERS + STEM_VOTERS + 4)
    words, stems = lexicon.words, lexicon.stems
    total = addressed = 0
    for found in _WORD.finditer(lowered):
        word = found[0]
        total += 1
        hit = word in _INSULTS
        out[WORD_VOTERS + STEM_VOTERS] += hit
        at = words.get(word)
        if at is not None:
            out[at] += 1
            hit = True
        if len(word) > 4:
            at = stems.get(word[:5], stems.get(word[:4]))
            if at is not None:
                out[WORD_VOTERS + at] += 1
                hit = True
        if hit and _ADDRESSED.search(lowered, max(0, found.start() - 40), found.start()):
            addressed += 1
    out[-3], out[-2], out[-1] = addressed, len(_SHOUT.findall(lowered)), total
    return out


def votes(counts: np.ndarray) -> np.ndarray:
    """1 toxic, -1 not toxic, 0 abstains; one column for each of ``Lexicon.voters``."""
    lexical = counts[:, : WORD_VOTERS + STEM_VOTERS + 1]
    hits, total = lexical.sum(axis=1), np.maximum(counts[:, -1], 1)
    columns = [np.where(lexical > 0, 1, 0)]
    columns.append(np.stack([hits >= 2, hits >= 0.01 * total, counts[:, -3] > 0, counts[:, -2] > 2], axis=1).astype(int) * (hits > 0)[:, None])
    columns.append(np.where(hits == 0, -1, 0)[:, None])
    return np.concatenate(columns, axis=1).astype(np.int8)


def inputs(counts: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: damped counts, share of hits, and a constant."""
    lexical = counts[:, : WORD_VOTERS + STEM_VOTERS + 1]
    hits, total = lexical.sum(axis=1), np.maximum(counts[:, -1], 1)
    extra = np.stack([np.log1p(hits), np.minimum(1, 20 * hits / total), (hits > 0), (hits > 1), np.ones(len(counts))], axis=1)
    return np.concatenate([np.log1p(lexical), np.log1p(counts[:, -3:-1]), extra], axis=1)


@dataclass
class LabelModel:
    """P(vote | class) of each voter, conditional correlations of voters, and the share of the toxic class."""

    prior: float
    table: np.ndarray  # voters x classes x votes (-1, 0, 1)
    correlation: np.ndarray

    @property
    def accuracies(self) -> np.ndarray:
        """How often a voter that does not abstain is right."""
        share = np.array([1 - self.prior, self.prior])
        right = self.table[:, 0, 0] * share[0] + self.table[:, 1, 2] * share[1]
        spoken = right + self.table[:, 0, 2] * share[0] + self.table[:, 1, 0] * share[1]
        return right / np.maximum(spoken, 1e-12)

    def posterior(self, given: np.ndarray) -> np.ndarray:
        """P(toxic | votes). A voter counts the less, the more it repeats what others say given the class."""
        weight = 1 / (1 + np.clip(self.correlation, 0, 1).sum(axis=1))
        odds = np.log(self.table[:, 1]) - np.log(self.table[:, 0])
        total = np.log(self.prior) - np.log(1 - self.prior) + sum(weight[j] * odds[j][given[:, j] + 1] for j in range(given.shape[1]))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_label_model(given: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation from a majority vote; in each round, voter tables and then correlations given the class.

    It sees votes alone, no label. Where all rows are on one side of the vote, those above the mean begin as toxic.
    """
    prior = min(0.9, max(0.01, prior))
    total = given.sum(axis=1)
    above = total > 0
    toxic = np.where(above if 0 < above.sum() < len(above) else total > total.mean(), 0.9, 0.05)
    model = None
    for _ in range(rounds):
        classes = np.stack([1 - toxic, toxic])
        counts = np.stack([classes @ (given == vote) for vote in (-1, 0, 1)], axis=2)  # classes x voters x votes
        table = (counts + 0.5) / (counts + 0.5).sum(axis=2, keepdims=True)
        covariance, spread = np.zeros((given.shape[1],) * 2), np.zeros(given.shape[1])
        for c in (0, 1):
            centred = given - (classes[c] @ given) / max(classes[c].sum(), 1e-9)
            covariance += (centred * classes[c][:, None]).T @ centred
            spread += classes[c] @ centred**2
        scale = np.sqrt(np.maximum(spread, 1e-9))
        correlation = covariance / np.outer(scale, scale)
        np.fill_diagonal(correlation, 0)
        model = LabelModel(prior, table.transpose(1, 0, 2), np.where(np.isfinite(correlation), correlation, 0))
        toxic = model.posterior(given)
    return model


def fit_classifier(x: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        weights = weights + np.linalg.solve(hessian, x.T @ (soft - p) - ridge * weights)
    return weights


def calibrate(x: np.ndarray, weights: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Scale and shift of a classifier's log odds, by given labels; the last input is constant."""
    odds = x @ weights
    scale, shift = fit_classifier(np.stack([odds, np.ones(len(odds))], axis=1), label, ridge=0.1)
    out = weights * scale
    out[-1] += shift
    return out


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    labels: LabelModel | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        counts = np.stack([evidence(text, self.lexicon) for text in texts])
        return 1 / (1 + np.exp(-np.clip(inputs(counts) @ self.weights, -30, 30)))


def _labelled(documents: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    """Texts of labelled documents; an id with several labels is toxic if one says so.

    ``how`` is the join: "merge" for all labels, which grow with the corpus, so the plan is the same at every size; "broadcast" for a sample
    of bounded size.
    """
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return documents.select("doc_id", "text").join(given.hint(how), "doc_id")


def mine_lexicon(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """Words and stems that toxic documents have and others lack, from all labelled documents.

    Document counts of words are an aggregate with a partial step; the lexicon is the top of it, so its
    size is bounded. Rare words count in totals and stems as well. A stem needs at least three words.
    """
    split = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    counted = _labelled(documents, labels, "merge").select("toxic", F.explode(split).alias("word")).where("length(word) between 2 and 64")
    words = materialize(counted.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "word-counts")
    totals = words.agg(F.sum("pos"), F.sum("neg")).first()
    pos, neg = max(1, totals[0] or 0), max(1, totals[1] or 0)

    def top(counts: DataFrame, name: str, n: int) -> list[str]:
        ratio = ((F.col("pos") + 0.5) / F.lit(float(pos))) / ((F.col("neg") + 0.5) / F.lit(float(neg)))
        rated = counts.withColumn("ratio", ratio).where((F.col("pos") >= LEAST_TOXIC) & (F.col("ratio") >= LEAST_RATIO))
        return [r[0] for r in rated.orderBy((F.log("ratio") * F.sqrt("pos")).desc(), name).select(name).limit(n).collect()]

    stems = words.where("length(word) > 4").select(F.explode(F.array(F.substring("word", 1, 4), F.substring("word", 1, 5))).alias("stem"), "pos", "neg")
    stems = stems.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("*").alias("n")).where("n >= 3")
    return Lexicon({w: i % WORD_VOTERS for i, w in enumerate(top(words, "word", LEXICON_WORDS))}, {s: i % STEM_VOTERS for i, s in enumerate(top(stems, "stem", LEXICON_STEMS))})


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from labelled documents for which ``learn`` (over doc_id) holds.

    Labels choose the lexicon and the share of the toxic class. The label model estimates from the votes alone, on about ``fit_rows`` documents (chosen
    by a hash of the id), how right and how alike the voters are, and its posteriors are what the classifier learns; labels then scale and shift its log odds (two
    numbers). Where the labelled rows are not of both classes, only the fixed list counts, with fixed weights.
    """
    learned = labels.where(F.lit(True) if learn is None else learn).where("doc_id is not null and toxic is not null")
    lexicon = mine_lexicon(documents, learned)
    total = learned.count()
    share = int(min(1.0, fit_rows / max(1, total)) * (1 << 30))
    chosen = learned.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share).select("doc_id", "toxic")

    def make():
        return lambda texts: [[evidence(t, lexicon).tolist() for t in texts]]

    rows = map_texts(_labelled(documents, chosen, "broadcast"), "text", make, "counts array<double>").select("doc_id", "toxic", "counts").collect()
    counts = np.array([r.counts for r in sorted(rows, key=lambda r: r.doc_id)]).reshape(len(rows), WORD_VOTERS + STEM_VOTERS + 4)
    given = votes(counts)
    label = np.array([r.toxic for r in sorted(rows, key=lambda r: r.doc_id)])
    if len(set(label.tolist())) < 2:
        size = inputs(np.zeros((1, WORD_VOTERS + STEM_VOTERS + 4))).shape[1]
        weights = np.zeros(size)
        weights[-5:] = [1.0, 1.0, 1.0, 1.5, -3.0]
        return ToxicityModel(lexicon, weights, None)
    model, x = fit_label_model(given, float(label.mean())), inputs(counts)
    return ToxicityModel(lexicon, calibrate(x, fit_classifier(x, model.posterior(given), ridge=0.1), label), model)


def with_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Append score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone; other columns stay.

    Null and empty texts are scored as texts without words. Repeated rows get the same, an empty table gives no row.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        def compute(texts):
            score = shipped.value.score(texts)
            return [score.tolist(), (score >= 0.5).astype(int).tolist()]

        return compute

    return map_texts(documents, "text", make, "score double, predicted int")


def learn_fold() -> Column:
    return fold_remainder("doc_id", 5) != 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(documents.where(learn_fold()), labels, learn_fold())
    return with_toxicity(documents.select("doc_id", "text", (~learn_fold()).alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
