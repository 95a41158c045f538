"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Whole, lean, pick, raw_bytes
from .learning import labelled_sample, logistic, sigmoid

#: Lower-cases A-Z; all other ASCII that is neither letter nor digit becomes a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
STEMS = (5, 6, 7)

#: The chain's categories in order, as conditions on the label columns. The labels at hand have one category of
#: toxicity; the one before it is what they tell of quality, which says something about toxicity, not the same. Labels
#: with more categories go here in the order in which they are to be predicted.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def text_features(text: bytes | None) -> set:
    """The distinct words, and their first bytes (marked as beginnings) for words that go on."""
    words = set((text or b"").translate(TO_WORDS).split())
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + b"-" for w in words if len(w) > n)
    return out


class ToxicityChain:
    """One logistic model per category, each fed the earlier categories' probabilities.

    Features are the presence of words and word beginnings. In training, the
    earlier categories' probabilities come from models that have not seen the
    document (out of fold), as they will be when documents are scored.
    """

    def __init__(self, names: list[str], vocabulary: list[bytes], weights: list[np.ndarray]):
        self.names, self.weights = names, weights
        self.index = {w: i for i, w in enumerate(vocabulary)}

    @classmethod
    def fit(cls, names: list[str], vocabulary: list[bytes], present: list, y: np.ndarray, folds: int = 5, penalty: float = 5e-4) -> ToxicityChain:
        n = len(present)
        x = np.zeros((n, len(vocabulary)), dtype=np.float32)
        for i, columns in enumerate(present):
            x[i, columns] = 1
        fold = np.arange(n) % folds
        weights = []
        for j in range(len(names)):
            target = y[:, j].astype(np.float32)
            weights.append(logistic(x, target, penalty))
            probability = np.zeros(n, dtype=np.float32)
            for f in range(folds):
                other = fold != f
                if other.any() and (~other).any():
                    w = logistic(x[other], target[other], penalty)
                    probability[~other] = sigmoid(x[~other] @ w[:-1] + w[-1])
            x = np.hstack([x, probability[:, None]])
        return cls(names, vocabulary, weights)

    def score(self, texts: list) -> np.ndarray:
        """A row of the categories' probabilities for each text."""
        out = np.zeros((len(texts), len(self.names)))
        known = self.index.keys()
        for i, text in enumerate(texts):
            columns = [self.index[w] for w in text_features(text) & known]
            for j, w in enumerate(self.weights):
                out[i, j] = sigmoid(float(w[columns].sum() + out[i, :j] @ w[len(self.index) : len(self.index) + j] + w[-1]))
        return out


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = 6000, features: int = 600, least_docs: int = 5, least_apart: float = 3.5) -> ToxicityChain:
    """A chain from at most ``sample`` labelled documents.

    Their features are written once. For each category, the ``features`` that set its documents most apart (by
    ``least_apart`` standard deviations or more) are chosen by counts over the sample; the driver gets those and, for each
    document, which of them it has. Labels that repeat or disagree are averaged, null ones don't count; without any,
    or with a category that all or none have, the weights for it say just that.
    """
    columns = ["quality", "toxic"]
    schema = f"doc_id long, features array<binary>, {', '.join(f'c{j} int' for j in range(len(categories)))}"

    def extract(batches):
        for b in batches:
            found = pa.array([sorted(text_features(t)) for t in raw_bytes(b.column(1))], pa.list_(pa.binary()))
            yield pa.record_batch([b.column(0), found, *b.columns[2:]], names=[x.split()[0] for x in schema.split(", ")])

    rows = labelled_sample(docs, labels, columns, sample)
    rows = rows.select("doc_id", "text", *[F.expr(f"CAST({sql} AS int)").alias(f"c{j}") for j, sql in enumerate(categories.values())])
    scratch = Scratch(spark)
    rows = scratch.keep(rows.mapInArrow(extract, schema))
    js = range(len(categories))
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"c{j}"), F.lit(0)).alias(f"p{j}") for j in js]).first()
    counts = rows.select(F.explode("features").alias("w"), *[f"c{j}" for j in js]).groupBy("w").agg(F.count("*").alias("df"), *[F.sum(f"c{j}").alias(f"p{j}") for j in js]).filter(F.col("df") >= least_docs)
    chosen: set[bytes] = set()
    for j in js:
        p, n = total[f"p{j}"], total["n"]
        if 0 < p < n:
            # Observed against expected documents of the category, in standard deviations.
            expected = F.col("df") * (p / n)
            apart = F.abs(F.col(f"p{j}") - expected) / F.sqrt(expected * (1 - p / n) + 0.5)
            chosen |= {bytes(r.w) for r in counts.filter(apart >= least_apart).orderBy(F.desc(apart), "w").limit(features).select("w").collect()}
    vocabulary = sorted(chosen)
    index = {w: i for i, w in enumerate(vocabulary)}

    def look_up(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([[index[w] for w in f if w in index] for f in b.column(1).to_pylist()], pa.list_(pa.int32())), *b.columns[2:]], names=["doc_id", "present", *[f"c{j}" for j in js]])

    data = rows.mapInArrow(look_up, schema.replace("features array<binary>", "present array<int>")).collect()
    scratch.drop(rows)
    data.sort(key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % (1 << 64), r.present))
    y = np.array([[r[f"c{j}"] for j in js] for r in data]).reshape(-1, len(categories))
    return ToxicityChain.fit(list(categories), vocabulary, [r.present for r in data], y)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.4, **fit) -> DataFrame:
    """doc_id, p_<category> for each category, rejected (the toxic one reaches ``threshold``).

    One row for each row of ``docs``, from whole texts. Null and empty texts
    have no features and get the intercepts. Ids may be null or repeat.
    Without labels nothing is learned: every probability is one half and no
    document is rejected. The threshold is below one half since a toxic document that
    stays does more harm than a clean one that goes; the README has what it means on held-out labels.
    An empty table gives no rows.
    """
    chain = fit_toxicity(spark, docs, labels, **fit)
    learned = any(abs(w).sum() for w in chain.weights)
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names)

    def score(batches):
        for b in batches:
            p = chain.score(raw_bytes(b.column(1)))
            yield pa.record_batch([b.column(0), *[pa.array(p[:, j], pa.float64()) for j in range(p.shape[1])]], names=[x.split()[0] for x in schema.split(", ")])

    found = pick(docs, doc_id="long", text="string").mapInArrow(lean(score), schema)
    return found.withColumn("rejected", (F.col("p_toxic") >= threshold) if learned else F.lit(False))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.4, **fit) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` doesn't reject, with all their columns; each is judged where it lies.

    Nulls, repeats and empty tables as there: each row is judged by its own text, whatever its id, and without
    labels all rows stay.
    """
    chain = fit_toxicity(spark, docs, labels, **fit)
    if not any(abs(w).sum() for w in chain.weights):
        return docs
    place = chain.names.index("toxic")

    @F.arrow_udf("double")
    def p_toxic(texts: pa.Array) -> pa.Array:
        return pa.array(chain.score(raw_bytes(texts))[:, place], pa.float64())

    whole = Whole(docs, text="string")
    return whole.back(whole.rows.filter(p_toxic("text") < threshold))
