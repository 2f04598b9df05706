"""Quality classifier by positive-unlabelled learning with the non-negative risk (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import binary, pieces

#: Bound of the fitting sample: rows of each class, those with the smallest hash of their text.
SAMPLE = 20_000
#: Each measure is cut into cells at these quantiles of the sample; the tails are finer, as kinds of junk are rare.
CUTS = (0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.85, 0.92, 0.96, 0.98, 0.99, 0.995)

#: Folds of the sample for the estimate of the class prior.
FOLDS = 4

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]
MEASURES = 17


def measures(text: bytes | None) -> list[float]:
    """What the score sees of a text: shares of kinds of bytes, and how words and lines repeat."""
    text = text or b""
    n = max(1, len(text))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(c[_UPPER].sum()), int(c[_LOWER].sum())
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    bare = sum(not (x[0] >= 128 or 65 <= x[0] <= 90 or 97 <= x[0] <= 122) for x in words)
    return [
        upper / max(1, upper + lower), lower / n, c[_DIGIT].sum() / n, c[_SIGNS].sum() / w, c[33] / w,
        (c[9:14].sum() + c[32]) / n, c[128:].sum() / n, len(set(words)) / w, pairs / max(1, len(words) - 1),
        sum(a == b for a, b in zip(words, words[1:])) / w, bare / w, sum(map(len, words)) / w,
        len(set(lines)) / max(1, len(lines)), (c[46] + c[63]) / w, c[44] / w, c[124] / w, np.log1p(len(words)),
    ]


@dataclass
class Model:
    """Logistic score over cells of the measures."""

    edges: np.ndarray  # MEASURES x len(CUTS)
    weights: np.ndarray  # one per cell and the bias
    prior: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        return at + np.arange(len(self.edges)) * (self.edges.shape[1] + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.cells(x)].sum(axis=1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """Share of positives among the unlabelled, from the scores of a classifier between the two.

    Where the score is high, unlabelled rows are positives alone: the smallest ratio of the two
    shares above a threshold, over thresholds that leave at least `least` of the positives.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 40))
    above = [(np.mean(unlabelled >= t), np.mean(positive >= t)) for t in cuts]
    return float(np.clip(min(u / p for u, p in above if p > 0), 0.01, 0.99))


def _fit(cells_p: np.ndarray, cells_u: np.ndarray, size: int, prior: float | None, rounds: int = 250, rate: float = 0.1,
         decay: float = 3e-4) -> np.ndarray:
    """Weights that minimise the logistic risk; without a prior, of positive against unlabelled.

    With one, the non-negative unbiased risk prior * R+(P) + max(0, R-(U) - prior * R-(P)): while the estimate of the
    negative part is below zero, the step goes against its gradient instead, as the published algorithm has it.
    """
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(w[cells_p].sum(axis=1) + w[-1])))
        u = 1 / (1 + np.exp(-(w[cells_u].sum(axis=1) + w[-1])))

        def gradient(cells: np.ndarray, of_score: np.ndarray) -> np.ndarray:
            g = np.bincount(cells.ravel(), np.repeat(of_score, cells.shape[1]), minlength=size)
            g[-1] = of_score.sum()
            return g / len(of_score)

        if prior is None:
            g = gradient(cells_p, p - 1) + gradient(cells_u, u)
        else:
            negative = -np.mean(np.log(1 - u + 1e-12)) + prior * np.mean(np.log(1 - p + 1e-12))
            part = gradient(cells_u, u) - prior * gradient(cells_p, p)
            g = prior * gradient(cells_p, p - 1) + part if negative >= 0 else -part
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray, cuts: tuple[float, ...] = CUTS) -> Model:
    """Model from measures of trusted positives and of unlabelled rows; a constant score of 0.5 without either."""
    columns, cells = positive.shape[1], len(cuts) + 1
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((columns, cells - 1)), np.zeros(columns * cells + 1), 0.5)
    both = np.concatenate([positive, unlabelled])
    model = Model(np.quantile(both, cuts, axis=0).T, np.zeros(columns * cells + 1), 0.5)
    cp, cu, size = model.cells(positive), model.cells(unlabelled), columns * cells + 1
    # Scores for the prior come from folds that did not see the row: else the fit pulls the two classes apart.
    fold_p, fold_u = np.arange(len(cp)) % FOLDS, np.arange(len(cu)) % FOLDS
    score_p, score_u = np.zeros(len(cp)), np.zeros(len(cu))
    for k in range(FOLDS if min(len(cp), len(cu)) >= 2 * FOLDS else 0):
        model.weights = _fit(cp[fold_p != k], cu[fold_u != k], size, None)
        score_p[fold_p == k] = model.score(positive[fold_p == k])
        score_u[fold_u == k] = model.score(unlabelled[fold_u == k])
    model.prior = estimate_prior(score_p, score_u)
    model.weights = _fit(cp, cu, size, model.prior)
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        x = [measures(t) for t in binary(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], names=["x"])


def train(docs: DataFrame, positives: DataFrame, excluded=None, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` positive and `sample` unlabelled rows of docs, those with the smallest hash of id and text.

    positives: (doc_id, positive) of the labelled rows; rows of docs without one are unlabelled.  excluded: condition on
    doc_id; such rows are not used.
    """
    rows = docs.select("doc_id", "text")
    if excluded is not None:
        rows = rows.where(~F.coalesce(excluded, F.lit(False)))
    labels = positives.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("positive").alias("positive"))
    # Ids and hashes go first; texts of the chosen alone follow.
    slim = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"))
    marked = slim.join(labels, F.col("doc_id") == F.col("l_id"), "left")

    def chosen(condition: str) -> np.ndarray:
        ids = marked.where(condition).orderBy("h").limit(sample).select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"))
        texts = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("c_id")) & (F.xxhash64("doc_id", "text") == F.col("c_h")), "left_semi")
        table = texts.orderBy(F.xxhash64("doc_id", "text")).select("text").mapInArrow(_measured, "x array<double>").toArrow()
        return np.array(table.column(0).to_pylist(), float).reshape(-1, MEASURES)

    return fit(chosen("positive"), chosen("l_id is null"))


def _score(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in pieces(batches):
            x = np.array([measures(t) for t in binary(batch.column(at))], float).reshape(-1, MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted.score(x), pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, from the text alone; null texts score as empty ones.  A column named score is replaced."""
    names = [n for n in docs.columns if n != "score"]
    rows = docs.select(*[F.col(f"`{n}`") for n in names])
    schema = rows.withColumn("score", F.lit(None).cast("double")).schema
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), names.index("text")), schema)


def positives(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").select("doc_id", (F.coalesce("quality", F.lit(0)) == 1).alias("positive"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= threshold).

    Labels are learnt only from rows that are not held out.  Null ids are not held out and never labelled; labels
    of unknown documents and null labels say nothing; of several labels of a document the worst counts.
    """
    model = train(docs, positives(labels), held_out(F.col("doc_id")))
    out = score(docs.drop("held_out", "predicted"), model)
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
