"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The learner keeps a learning rate per coordinate and an L1 penalty, so features
that few documents show keep a weight of exactly zero and the broadcast weights
stay small. It learns from a bounded sample of labelled texts in one task;
every document is then scored where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.llm.common import WordHashes, gram_buckets, label_sample, labelled_texts

#: Labelled texts that the learner sees at most.
MOST_TEXTS = 16_000
BITS = 20
#: Words, pairs of neighbours, and pairs with one word left out between them.
GRAMS = ((0,), (0, 1), (0, 2))
#: Punctuation taken off before words are parted.
PUNCTUATION = b".,;:!?\"'()[]#*$%&|<>"


@dataclass(frozen=True)
class Ftrl:
    """The learner's parameters."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    passes: int = 4


class Features:
    """Buckets of a text's grams, each once."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = text.lower().encode().translate(None, PUNCTUATION).split() if text else []
        hashes = self.hashes.of(words)
        return np.unique(np.concatenate([gram_buckets(hashes, g, BITS) for g in GRAMS]))


def learn(texts: list[str | None], marks: list[int], how: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias, which has no penalty.

    Texts are seen in the order given. The bias is a coordinate of its own.
    """
    features = Features()
    seen = [features.of(t) for t in texts]
    bias = 1 << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        limit = np.where(at == bias, 0.0, how.l1)
        w = (np.sign(pull) * limit - pull) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        return np.where(np.abs(pull) <= limit, 0.0, w)

    for _ in range(how.passes):
        for buckets, mark in zip(seen, marks, strict=True):
            at = np.append(buckets, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - mark
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = np.arange(bias + 1)
    w = weights(every)
    at = np.flatnonzero(w[:bias])
    return at, w[at], float(w[bias])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS, how: Ftrl = Ftrl()) -> pd.DataFrame:
    """The model as rows ``bucket, weight``; bucket -1 is the bias.

    At most ``most`` labelled ids are taken, by hash, with one text each, so the
    one training task and the result are bounded whatever the input. Without labelled texts the
    bias alone is returned, as 0.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "text"], na_position="first")
        at, weight, bias = learn(rows["text"].tolist(), rows["_label"].tolist(), how)
        return pd.DataFrame({"bucket": np.append(at, -1), "weight": np.append(weight, bias)})

    sample = labelled_texts(docs, label_sample(labels, "toxic", most))
    sample = sample.select(F.xxhash64(F.col("doc_id").cast("string"), F.lit("order")).alias("_order"), "text", "_label")
    model = sample.groupBy(F.lit(1).alias("_all")).applyInPandas(fit, "bucket long, weight double").toPandas()
    return model if len(model) else pd.DataFrame({"bucket": [-1], "weight": [0.0]})


def score(spark: SparkSession, model: pd.DataFrame, text: str = "text") -> Column:
    """The probability of label 1 as a column; 0 to 1 for every text, empty or null too."""
    dense = np.zeros((1 << BITS) + 1, np.float32)
    dense[model["bucket"].to_numpy()] = model["weight"].to_numpy()
    weights = spark.sparkContext.broadcast(dense)

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, features = weights.value, Features()
        bias = float(w[-1])
        for texts in batches:
            sums = np.array([bias + float(w[features.of(t)].sum(dtype=np.float64)) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return udf(F.col(text).cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether an id's label is kept from the learner; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on_fold(docs: DataFrame, labels: DataFrame, **options) -> pd.DataFrame:
    return train(docs, labels.filter(~held_out(F.col("doc_id"))), **options)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    model = train_on_fold(docs, labels, **options)
    return docs.filter(score(docs.sparkSession, model) < threshold)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered form: one row per row of ``docs``."""
    model = train_on_fold(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs.sparkSession, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
