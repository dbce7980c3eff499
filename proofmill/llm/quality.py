"""Quality: regularised quadratic discriminant over transformed statistics of whole texts.

For each class the mean and a covariance, shrunk towards the pooled one and towards a diagonal, come from sums over all labelled rows.
A text's score rises with the difference of its Mahalanobis log-densities; each class keeps the Cholesky factor of
its covariance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import NAMES, features
from .util import Scratch, clean_names, table, text_bytes, text_slices

D = len(NAMES)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = features(*text_bytes(batch.column("text")))
            flat = pa.array(x.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), flat)], names=["doc_id", "x"])

    return clean_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class of rows(label, x): count, sum and sum of products. Summed within tasks first, then by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                labels = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(-1, D)
                for c in np.unique(labels):
                    own = np.hstack([np.ones((int((labels == c).sum()), 1)), x[labels == c]])
                    sums[int(c)] = sums.get(int(c), 0) + (own.T @ own)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * s.size, pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], names=["label", "at", "v"])

    parts = rows.select("label", "x").mapInArrow(run, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():  # at most (D + 1) ** 2 numbers a class
        out.setdefault(r["label"], np.zeros((D + 1) ** 2))[r["at"]] = r["v"]
    full = {c: s.reshape(D + 1, D + 1) for c, s in out.items()}
    return {c: (s[0, 0], s[0, 1:], s[1:, 1:]) for c, s in full.items()}


class Discriminant:
    """Two Gaussians. pooled and diagonal say how far each class covariance is shrunk."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, diagonal: float = 0.05):
        self.classes = sorted(c for c, s in sums.items() if s[0] >= 2)
        total = sum(s[0] for s in sums.values())
        center = sum(s[1] for s in sums.values()) / total
        scatter = sum(s[2] for s in sums.values()) / total - np.outer(center, center)
        self.center, self.scale = center, np.sqrt(np.maximum(np.diag(scatter), 1e-9))
        cov, mean = {}, {}
        for c in self.classes:
            n, s, p = sums[c]
            mean[c] = (s / n - center) / self.scale
            cov[c] = (p / n - np.outer(s / n, s / n)) / np.outer(self.scale, self.scale)
        within = sum(sums[c][0] * cov[c] for c in self.classes) / sum(sums[c][0] for c in self.classes)
        self.parts = {}
        for c in self.classes:
            s = (1 - pooled) * cov[c] + pooled * within
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(D)
            low = np.linalg.cholesky(s)
            self.parts[c] = (mean[c], np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), np.log(sums[c][0] / total))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density and prior of class 1 less those of class 0."""
        z = (x - self.center) / self.scale
        side = {}
        for c, (mean, inverse, logdet, prior) in self.parts.items():
            side[c] = prior - 0.5 * (logdet + (((z - mean) @ inverse.T) ** 2).sum(1))
        return side[1] - side[0]


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1) -> DataFrame:
    """A row for each document: doc_id, held_out, score (0 to 1, higher: class 1 likelier) and predicted.

    Labels of held-out ids are never learned; null labels and unknown ids are ignored, of a repeated label row the
    greatest counts. Null text: empty, scored like others. If either class has under two rows, all scores are 0.5.
    Null doc_id: scored, not held out.
    """
    scratch = Scratch(docs.sparkSession)
    x = scratch.stage(measured(docs), "statistics")
    y = clean_names(labels, ["doc_id", label]).where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    y = y.where(~held_out(F.col("doc_id"), modulus, remainder))
    sums = moments(x.join(y, "doc_id"))
    model = Discriminant(sums) if sum(s[0] >= 2 for s in sums.values()) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                d = model.difference(batch.column("x").flatten().to_numpy().reshape(-1, D))
                s = 1 / (1 + np.exp(-np.sign(d) * np.log1p(np.abs(d))))  # in order of d, and never stuck at 0 or 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = x.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", "predicted")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
