"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and an L1 penalty keeps all but the telling
ones at zero, so the weights that scoring needs are few and small to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import in_held_out, stored, whole_text

DIMENSIONS = 1 << 21
THRESHOLD = 0.3
# Labelled rows that the model is fitted on, at most: those of the lowest hash of doc_id.
MAX_ROWS = 8_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.2
WORDS_KEPT = 100_000
LONGEST_KEPT = 40
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Distinct hashed features of a text: words, pairs of words, and pairs around a word."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.shift = np.uint64(64 - dimensions.bit_length() + 1)
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        import xxhash

        found = self.cache.get(word)
        if found is None:
            found = xxhash.xxh64_intdigest(word.encode(), 1)
            if len(word) <= LONGEST_KEPT:
                if len(self.cache) >= WORDS_KEPT:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        words = re.findall(r"[^\W\d_]+", text.lower())
        h = np.fromiter(map(self.word, words), np.uint64, len(words))
        pairs = (h[:-1] * _MULTIPLY) ^ (h[1:] >> np.uint64(1))
        skips = (h[:-2] * _MULTIPLY) ^ (h[2:] >> np.uint64(2)) ^ np.uint64(0x5BD1E995)
        every = np.concatenate([h, pairs, skips]) * _MULTIPLY
        return np.unique((every >> self.shift).astype(np.int32))


def fit(examples: list[tuple[np.ndarray, int]], dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> tuple:
    """``(bias, places, weights)`` of the coordinates that are not zero."""
    # The last coordinate is the bias: always on, without L1.
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        signed = z[at]
        lasting = np.sign(signed) * np.maximum(np.abs(signed) - np.where(at == dimensions, 0.0, L1), 0.0)
        return -lasting / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            active, label = examples[k]
            at = np.append(active, dimensions)
            w = weights(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            sigma = (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / ALPHA
            z[at] += error - sigma * w
            n[at] += error * error
    touched = np.flatnonzero(n[:-1])
    w = weights(touched)
    return float(weights(np.array([dimensions]))[0]), touched[w != 0].astype(np.int64), w[w != 0]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple:
    """Weights learned from labelled rows that are not held out.

    At most ``max_rows`` labelled rows, chosen by hash, so that one task can hold their
    features (about 6 KB each); rows without a label or an id are left out, and of
    several labels of a document the highest counts.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = stored(chosen.limit(max_rows)).withColumnRenamed("doc_id", "labelled_id")

    @F.pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = Features()
        for batch in batches:
            yield pd.Series([extract(v) for v in batch])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "toxic"], kind="stable")
        bias, places, w = fit(list(zip(rows["x"], rows["toxic"], strict=True)))
        return pd.DataFrame({"place": [-1, *places], "weight": [bias, *w]})

    # The chosen rows are bounded by max_rows, so they can be sent to all tasks.
    examples = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select(
        F.lit("toxic").alias("model"), F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"),
        features(whole_text(F.col("text"))).alias("x"),
    )
    learned = examples.groupBy("model").applyInPandas(learn, "place long, weight double").toPandas()
    if learned.empty:
        return 0.0, np.empty(0, np.int64), np.empty(0)
    places, weights = learned["place"].to_numpy(), learned["weight"].to_numpy()
    return float(weights[places < 0][0]), places[places >= 0], weights[places >= 0]


def toxicity_score(docs: DataFrame, labels: DataFrame) -> Column:
    """Column with the score of each whole text, by a model trained on ``labels``.

    A null or empty text gets the score of the bias; without anything to learn from, all
    scores are 0.
    """
    bias, places, weights = train(docs, labels)
    if bias == 0.0 and not len(places):
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast((bias, places, weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, places, weights = shared.value
        extract, table = Features(), np.zeros(DIMENSIONS, dtype=np.float32)
        table[places] = weights
        for batch in batches:
            sums = np.array([bias + float(table[extract(v)].sum()) for v in batch])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30))))

    return score(whole_text(F.col("text")))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Scores read the whole text and nothing else.  A null doc_id is not held out and never
    learned from.  Repeated rows are scored each; further columns are not read.
    """
    result = docs.select(
        "doc_id", in_held_out(F.col("doc_id")).alias("held_out"), toxicity_score(docs, labels).alias("score")
    )
    return result.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose whole text scores below ``threshold``, with all their columns."""
    return docs.where(toxicity_score(docs, labels) < threshold)
