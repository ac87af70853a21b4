"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes nine transformed statistics.  Per class a mean and a covariance are
accumulated by one distributed aggregation of sums and cross products over *all* training
rows (no sample); the covariance is shrunk towards its own diagonal and towards the pooled
covariance; the score is the logistic of the difference of Gaussian log densities, whose
Mahalanobis terms use Cholesky factors computed once and shipped with the model.

Defined edge cases: null text is scored as the empty text; labels other than 0 and 1 (and
null) teach nothing; with no training row of a class the score is the share of the other
class (1.0 or 0.0), and 0.5 with none at all; repeated rows get equal scores; a label counts for
every row of its doc_id, and rows without an id are scored but teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, held_out, materialize, slices

STATS = ["log_words", "word_len", "punct", "upper", "alpha_words", "upper_words", "repeats", "distinct", "line_dups"]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text: logs of smoothed ratios, so that they are near normal."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = np.bincount(raw, minlength=256)
    words = text.split()
    n, upper, digits = len(words), int(c[65:91].sum()), int(c[48:58].sum())
    letters = upper + int(c[97:123].sum()) + int(c[192:].sum())
    punct = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    lines = text.split("\n")
    rate = lambda part, whole, a=0.5, b=20.0: float(np.log((part + a) / (whole + b)))
    return [
        float(np.log1p(n)),
        (letters + digits + 60.0) / (n + 12.0),
        rate(punct, letters),
        rate(upper, letters, 1.0),
        rate(sum(map(str.isalpha, words)), n, 16.0),
        rate(sum(map(str.isupper, words)), n),
        rate(sum(map(eq, words, words[1:])), n),
        float(np.log((len(set(words)) + 5.0) / (n + 5.0)) / np.log(n + 10.0)),
        rate(len(lines) - len(set(lines)), len(lines), 1.0, 10.0),
    ]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the text's digest ``_key`` and one double column per statistic; texts stay inside the Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x[:, i]) for i in range(len(STATS))]], names=["doc_id", "_key", *STATS])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest(text).alias("_key")).mapInArrow(run, f"doc_id {kind}, _key binary, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky inverses and log constants of the two classes; ``constant`` where a class is missing."""

    mean: np.ndarray
    inverse: np.ndarray
    offset: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, diagonal: float = 0.05, pooled: float = 0.1) -> Discriminant:
    """Fit on statistics joined to ``labels(doc_id, quality)``; one pass of sums, whatever the number of rows."""
    d = len(STATS)
    lab = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_q"))
    joined = stats.join(lab, F.col("doc_id") == F.col("_id"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count(F.lit(1)), *[F.sum(s) for s in STATS], *[F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i, j in pairs]]
    got = {r[0]: r[1:] for r in joined.groupBy("_q").agg(*sums).collect()}
    n = {k: got[k][0] if k in got else 0 for k in (0, 1)}
    if not n[0] or not n[1]:
        z = np.zeros((2, d))
        return Discriminant(z, np.zeros((2, d, d)), np.zeros(2), 0.5 if not n[0] + n[1] else float(n[1] > 0))
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        mean[k] = np.array(got[k][1 : d + 1]) / n[k]
        for (i, j), v in zip(pairs, got[k][d + 1 :], strict=True):
            cov[k, i, j] = cov[k, j, i] = v / n[k] - mean[k, i] * mean[k, j]
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    inverse, offset = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        a = (1 - pooled) * cov[k] + pooled * both
        a = (1 - diagonal) * a + diagonal * np.diag(np.diag(a)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(a)
        inverse[k] = np.linalg.inv(low)
        offset[k] = np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(low)).sum()
    return Discriminant(mean, inverse, offset)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, _key, score, predicted for every row of ``docs``, learnt from rows that aren't held out."""
    stats = materialize(with_statistics(docs), "quality")
    model = fit(stats.where(~held_out()), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(STATS))]).reshape(-1, len(STATS))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "_key", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, _key binary, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return scored(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject: each by its own text, with or without an id."""
    bad = scored(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("_bad"), F.col("_key").alias("_bad_key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (digest(docs["text"]) == bad["_bad_key"]), "left_anti")
