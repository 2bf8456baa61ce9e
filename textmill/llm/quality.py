"""Quality classifier: a regularised quadratic discriminant over transformed statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_map, shingle_hashes, stored, text_bytes

FEATURES = ("words", "word_length", "upper", "digits", "symbols", "shouts", "points", "wide", "spaces", "entropy",
            "distinct_words", "distinct_shingles", "repeated_lines", "line_length")
#: Byte classes counted for each text, as columns of a 256-row table.
_CLASSES = ("upper", "lower", "digits", "symbols", "shouts", "points", "wide", "spaces", "line_ends")


def _byte_classes() -> np.ndarray:
    members = {"upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "symbols": b"#*$%&|<>@^~=_+/\\{}[]",
               "shouts": b"!?", "points": b".,;:'\"()-", "wide": range(128, 256), "spaces": b" \t\r\x0b\x0c\n", "line_ends": b"\n"}
    out = np.zeros((256, len(_CLASSES)))
    for i, name in enumerate(_CLASSES):
        out[list(members[name]), i] = 1
    return out


BYTE_CLASSES = _byte_classes()


def text_features(text: bytes) -> list[float]:
    """The transformed statistics of a text: logarithms of sizes, square roots of shares. All are finite; empty texts give zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, symbols, shouts, points, wide, spaces, ends = (counts @ BYTE_CLASSES).tolist()
    size = len(text)
    words = text.lower().split()
    n = len(words)
    present = counts[counts > 0] / size
    lines = [line for line in (x.strip() for x in text.split(b"\n")) if line]
    root = np.sqrt
    return [float(x) for x in (
        np.log1p(n), np.log1p((size - spaces) / max(n, 1)), root(upper / max(upper + lower, 1)), root(digits / size), root(symbols / size),
        root(shouts / size), root(points / size), root(wide / size), root(spaces / size), -(present * np.log2(present)).sum(),
        np.log1p(len(set(words))) / np.log1p(max(n, 1)), len(shingle_hashes(words)) / max(n - 4, 1),
        root(1 - len(set(lines)) / max(len(lines), 1)), np.log1p(size / (ends + 1)))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the feature array of every row; a null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_features(t) for t in batch.column(1).to_pylist()])
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))],
                                          ["id", "features"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return batch_map(texts, work, "id long, features array<double>")


@dataclass(frozen=True)
class Discriminant:
    """log p(1 | x) - log p(0 | x) = bias + |w0 (x - m0)|^2 / 2 - |w1 (x - m1)|^2 / 2 with w the inverse Cholesky factors."""

    bias: float
    means: tuple[np.ndarray, ...] = ()
    whiteners: tuple[np.ndarray, ...] = ()

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        margin = np.full(len(rows), self.bias)
        if self.means:
            for sign, mean, whitener in zip((0.5, -0.5), self.means, self.whiteners):
                margin += sign * np.square((rows - mean) @ whitener.T).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def solve(counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray], shrinkage: float = 0.2,
          floor: float = 1e-3) -> Discriminant:
    """The discriminant from the count, sum and sum of outer products of each class.

    A class covariance is shrunk to the pooled one by `shrinkage`, and its diagonal raised by `floor` times the pooled variances,
    so it always has a Cholesky factor. With no rows, or rows of one class, the score is (n1 + 1) / (n + 2) everywhere.
    """
    if min(counts) < 1:
        return Discriminant(float(np.log((counts[1] + 1) / (counts[0] + 1))))
    means = [s / n for s, n in zip(sums, counts)]
    own = [q / n - np.outer(m, m) for q, n, m in zip(squares, counts, means)]
    pooled = (own[0] * counts[0] + own[1] * counts[1]) / sum(counts)
    ridge = np.diag(np.maximum(np.diag(pooled), 1e-6) * floor) + np.eye(len(pooled)) * 1e-6
    bias, whiteners = float(np.log(counts[1] / counts[0])), []
    for sign, cov in zip((0.5, -0.5), own):
        factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * pooled + ridge)
        bias += sign * 2 * float(np.log(np.diag(factor)).sum())
        whiteners.append(np.linalg.inv(factor))
    return Discriminant(bias, tuple(means), tuple(whiteners))


def fit(feature_rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Learn from all rows of `labels` whose id has features.

    Only class counts, sums and sums of products reach the driver: 2 x (1 + d + d^2) numbers. A label that is null is no
    label; of several labels of one id the mean decides, 1 at one half; an id whose row repeats counts once a row.
    """
    wanted = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
              .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label")))
    rows = feature_rows.join(wanted, "id").select("label", "features")
    d = len(FEATURES)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        parts = []
        for k in (0, 1):
            own = x[label == k]
            parts.append(np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)]))
        n = len(parts[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), 2)),
             pa.array(np.concatenate(parts))], ["label", "place", "value"])

    totals = batch_map(rows, work, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    found = np.zeros((2, 1 + d + d * d))
    for row in totals.collect():
        found[row["label"], row["place"]] = row["value"]
    return solve(found[:, 0].tolist(), list(found[:, 1:d + 1]), list(found[:, d + 1:].reshape(2, d, d)))


def scored(feature_rows: DataFrame, model: Discriminant) -> DataFrame:
    """id and score (0 to 1, higher: class 1 likelier) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return batch_map(feature_rows.select("id", "features"), work, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = 0.5) -> DataFrame:
    """id, score and predicted (1 if score >= threshold, else 0) for every row of `docs`, learned from `labels` and the same texts.

    The statistics are computed once and stored; text is never shuffled. Only the text enters a score. A null text counts
    as empty; rows that repeat get the same score; a null id is scored but never labelled. An empty table gives no rows.
    """
    rows = stored(features(docs, id_col, text_col), "features")
    result = scored(rows, fit(rows, labels, id_col, label_col))
    return result.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
