"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows with label 1; unlabelled texts are of all rows that may be trained on, without their labels. The share of positives
among the unlabelled, the class prior, is estimated from where a first classifier can still tell them apart; then a
logistic model minimises the non-negative unbiased risk
    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]).
The logistic loss is proper, so the model's output is a probability.

A text's features are shares and ratios of style: symbols, capitals, repeated words and lines, separators, lengths.

Defined results: null and empty texts have all features 0 and get the score of that; with no positives every score is
0.5. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import crc_mod, table, uniform

#: Trusted positives and unlabelled texts that the model is learned from, in expectation, each.
SAMPLE_ROWS = 8_000
STEPS, RATE, DECAY = 400, 0.05, 1e-3
THRESHOLD = 0.3
_SYMBOLS = b"#%&$*~^<>{}[]\\_=+@/"
_SENTENCE = b".!?"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [0.0] * N_FEATURES
    n, count = len(raw), len(words)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    return [
        share(_SYMBOLS) ** 0.5,
        share(b"|") ** 0.5,
        share(b"!") ** 0.5,
        share(b"0123456789") ** 0.5,
        share(_SENTENCE) ** 0.5,
        share(b",;:'\"()-") ** 0.5,
        sum(map(str.isupper, words)) / count,
        sum(map(str.istitle, words)) / count,
        sum(map(eq, words, words[1:])) / count,
        distinct / count,
        np.log(distinct + 1) / np.log(count + 1),
        1 - len(set(lines)) / max(len(lines), 1),
        min(n / count / 10, 3.0),
        np.log10(count),
    ]


N_FEATURES = 14


def expanded(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised and clipped features, their squares and a constant."""
    z = ((x - mean) / std).clip(-4, 4)
    return np.concatenate([z, z * z / 4, np.ones((len(z), 1))], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adam."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among rows u. A classifier of p against u orders the rows; where it is surest of positives, u
    has none but positives, so the prior is the least ratio of u's share to p's share above any threshold."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u)

    w = _descend(gradient, p.shape[1])
    sp, su = np.sort(p @ w), np.sort(u @ w)
    at = np.quantile(sp, np.linspace(0, 0.5, 51))  # thresholds above which at least half of the positives lie
    over_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
    over_u = 1 - np.searchsorted(su, at, "left") / len(su)
    slack = np.sqrt(over_u * (1 - over_u) / len(su) + over_p * (1 - over_p) / len(sp))
    return float(np.clip(((over_u + slack) / over_p).min(), 0.05, 0.99))


def minimised(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative unbiased risk."""

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        negative = np.log1p(np.exp(gu.clip(-30, 30))).mean() - prior * np.log1p(np.exp(gp.clip(-30, 30))).mean()
        of_negative = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        if negative < 0:
            return -of_negative  # the empirical risk of the negatives fell below what is possible: step back
        return -prior * (p.T @ (1 - _sigmoid(gp))) / len(p) + of_negative

    return _descend(gradient, p.shape[1])


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    prior: float


def learned(p: np.ndarray, u: np.ndarray) -> Model:
    mean, std = u.mean(0), np.maximum(u.std(0), 1e-3)
    ep, eu = expanded(p, mean, std), expanded(u, mean, std)
    prior = estimated_prior(ep, eu)
    return Model(mean, std, minimised(ep, eu, prior), prior)


def _extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from about so many positives and as many texts of the rows that `trained_on` admits."""
    positive = labels.where(trained_on & (F.col("quality") == 1)).select("doc_id").distinct()
    n_positive, n_docs = positive.count(), docs.where(trained_on).count()
    chosen = positive.where(uniform("doc_id") < min(1.0, rows / max(n_positive, 1)))
    taken = lambda df: np.stack(df.orderBy("doc_id").toPandas()["x"].map(np.asarray).tolist() or [np.zeros(N_FEATURES)])  # noqa: E731  14 numbers for each row of the sample
    p = taken(_extracted(docs.join(F.broadcast(chosen), "doc_id", "left_semi")))
    u = taken(_extracted(docs.where(trained_on & (uniform("doc_id", 13) < min(1.0, rows / max(n_docs, 1))))))
    if not n_positive:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES + 1), 0.5)
    return learned(p, u)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            made = (expanded(x, m.mean, m.std) * m.weights).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(made))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
