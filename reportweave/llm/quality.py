"""Quality of documents: classifier evidence shrunk towards the record of their path and host.

A small classifier reads each text.  Its verdicts, and labels where there are any, are added
up by host and by path within a host; empirical Bayes sets how many documents a site must
have before its own rate outweighs that of the level above.  A document's score adds its
own evidence to the posterior of its path, in log odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import in_held_out, stored, whole_text

KEEP_FROM = 0.5
# Labelled rows that the classifier is fitted on, at most: those of the lowest hash of doc_id.
MAX_ROWS = 20_000
# Strength of a prior, in documents, if sites differ by no more than chance.
STRONGEST = 1000.0
N_FEATURES = 10


def text_features(text: str) -> list[float]:
    """Shares that tell prose from menus, shouting, symbols and repetition; any text has all of them."""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    spaces = n - len("".join(words))
    return [
        letters / n,
        sum(map(len, re.findall(r"[A-ZÀ-Þ]+", text))) / n,
        sum(map(len, re.findall(r"\d+", text))) / n,
        (n - letters - spaces) / n,
        text.count("|") / w,
        sum(1 for x in words if len(x) > 2 and x[-1] == x[-2] and not x[-1].isalnum()) / w,
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        min(5.0, np.log1p(len(words)) / 2),
        letters / w / 10,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, spread, weights)`` of a ridge logistic regression by Newton steps; the bias comes last.

    Squares and products of the standardised features are added, as shares matter at both ends.
    """
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    design = expanded((x - mean) / spread)
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    a, b = np.triu_indices(z.shape[1])
    return np.column_stack([z, z[:, a] * z[:, b], np.ones(len(z))])


def train_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple | None:
    """A classifier fitted on at most ``max_rows`` labelled rows that are not held out, chosen by hash.

    None without labels of both kinds.  What is fetched is max_rows times N_FEATURES numbers.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = stored(chosen.limit(max_rows)).withColumnRenamed("doc_id", "labelled_id")

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_features(v) for v in batch])

    # The chosen rows are bounded by max_rows, so they can be sent to all tasks.
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select(
        "doc_id", "quality", features(whole_text(F.col("text"))).alias("x")
    ).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    y = rows["quality"].to_numpy(dtype=float)
    return fit_logistic(np.array(rows["x"].tolist()), y) if len(set(y)) == 2 else None


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """``(of_host, of_path, host_score, path_score, prior)`` from ``(host, path, good)``, good from 0 to 1.

    Each level is a grouped sum.  Prior strengths come from the method of moments over
    the sites of a level: ``m = r (1 - r) / variance beyond chance``.
    """
    paths = stored(evidence.groupBy("host", "path").agg(F.count("good").alias("n"), F.sum("good").alias("good")))
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    prior = hosts.agg(F.sum("host_good") / F.sum("host_n")).first()[0]

    def strength(sites: DataFrame, n: Column, good: Column, rate: Column) -> float:
        """Strength of a level's prior, in documents, from the spread of its sites around the rates above them."""
        chance = rate * (1 - rate) / n
        beyond, typical = sites.agg(
            F.sum(n * ((good / n - rate) ** 2 - chance)) / F.sum(n), F.sum(n * rate * (1 - rate)) / F.sum(n)
        ).first()
        return min(STRONGEST, typical / beyond) if beyond and beyond > 0 else STRONGEST

    rate = F.lit(prior).cast("double")
    host_m = strength(hosts, F.col("host_n"), F.col("host_good"), rate)
    host_score = (F.col("host_good") + host_m * rate) / (F.col("host_n") + host_m)
    hosts = hosts.select(F.col("host").alias("of_host"), host_score.alias("host_score"))
    below = stored(paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))))
    path_m = strength(below, F.col("n"), F.col("good"), F.col("host_score"))
    path_score = (F.col("good") + path_m * F.col("host_score")) / (F.col("n") + path_m)
    return below.select(
        "of_host", F.col("path").alias("of_path"), "host_score", path_score.alias("path_score"), rate.alias("prior")
    )


def _logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def judge_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``(doc_id, host, path, held_out, doc_score, host_score, path_score, score, keep)`` of every document.

    Labels of held-out rows are never read.  A null host or path is a site like any other;
    a null text is judged as an empty one.  Without labels of both kinds every doc_score is
    0.5.  Repeated rows are judged each and count each; further columns are not read.
    """
    model = train_classifier(docs, labels)

    if model is None:
        score = F.lit(0.5)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mean, spread, w = shared.value
            for batch in batches:
                x = np.array([text_features(v) for v in batch]).reshape(-1, N_FEATURES)
                yield pd.Series(1 / (1 + np.exp(-np.clip(expanded((x - mean) / spread) @ w, -30, 30))))

        score = classify(whole_text(F.col("text")))

    judged = stored(docs.select(
        "doc_id", host.alias("host"), path.alias("path"), in_held_out(F.col("doc_id")).alias("held_out"),
        score.alias("doc_score"),
    ))
    known = labels.where(F.col("quality").isNotNull() & ~in_held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("labelled_id")).agg(F.min("quality").cast("double").alias("label"))
    evidence = judged.join(known, F.col("doc_id") == F.col("labelled_id"), "left").select(
        "host", "path", F.coalesce("label", "doc_score").alias("good")
    )
    sites = site_posteriors(evidence)
    joined = judged.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    combined = _logit(F.col("doc_score")) + _logit(F.col("path_score")) - _logit(F.col("prior"))
    return joined.select(
        "doc_id", "host", "path", "held_out", "doc_score", "host_score", "path_score",
        (1 / (1 + F.exp(-combined))).alias("score"),
    ).withColumn("keep", F.col("score") >= KEEP_FROM)
