"""Quality classifier: regularised quadratic discriminant on document statistics.

A document is ``STATISTICS`` numbers: logarithms of its size and of smoothed
shares of symbols, capital words, repeated words and lines, and the like.  Each
class (label 1 or 0) is a Gaussian over them.  Its covariance is shrunk twice
(Friedman, 1989): towards the pooled covariance by ``to_pooled``, then towards a
multiple of the identity by ``to_identity``; so a statistic that never varies in
one class keeps a finite weight.  Each covariance is factored once (Cholesky),
and the inverse factor goes to the tasks with the model: the Mahalanobis distance
of a document is the length of one matrix product.

The score is the logistic of the log-density difference for each statistic plus
the log prior odds.  Dividing by the number of statistics keeps the score from
running to 0 or 1, as the statistics depend on each other.

Scale: texts are read once, for the statistics, which are written to the shared
folder; labels meet statistics, not texts.  Labels are counted by key before the
join, so repeated keys on both sides don't multiply.  Moments are summed in each
task, then by class and place; the driver receives 2 x (1 + d + d x d) numbers.

Defined results: a null text counts as empty and has a score like any other text;
a row with a null key or without a label teaches nothing, nor does a label other
than 0 or 1; every label of a repeated key counts.  With labels of one class only
the score is that class, without labels 0.5.  Only the named columns are read, so
others cannot clash; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import batches
from storyloom.session import cut_lineage

TO_POOLED = 0.1
TO_IDENTITY = 0.02
THRESHOLD = 0.3
#: Least mean variance that a class is shrunk towards, so classes without spread have a factor.
LEAST_VARIANCE = 0.01
#: Words that a share is smoothed by, and the least share told from none.
SMOOTHING, FLOOR = 10, 0.02

_SYMBOLS, _SHOUTS, _STOPS, _PAUSES = b"#*$%&|<>", b"!?", b".", b",;:"
_DIGITS, _JOINTS = b"0123456789", b"/@_=+-"
STATISTICS = ("chars", "word_length", "symbols", "capital_words", "shouts", "repeated_words", "distinct_words",
              "repeated_lines", "digits", "joints", "words_per_line", "stops", "pauses")


def statistics(raw: bytes) -> list[float]:
    """The ``STATISTICS`` of a text."""
    text = raw.decode()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = len(words), len(raw)

    def marks(kind: bytes) -> int:
        return size - len(raw.translate(None, kind))

    def share(part: int, whole: int) -> float:
        return math.log(part / (whole + SMOOTHING) + FLOOR)

    return [
        math.log1p(len(text)),
        math.log((sum(map(len, words)) + SMOOTHING / 2) / (n + 1)),
        share(marks(_SYMBOLS), n),
        share(sum(map(str.isupper, words)), n),
        share(marks(_SHOUTS), n),
        share(sum(map(str.__eq__, words, words[1:])), n),
        math.log(len(set(words)) + SMOOTHING) / math.log(n + SMOOTHING),
        share(len(lines) - len(set(lines)), len(lines)),
        share(marks(_DIGITS), size),
        share(marks(_JOINTS), size),
        math.log((n + SMOOTHING) / (len(lines) + 1)),
        share(marks(_STOPS), n),
        share(marks(_PAUSES), n),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "statistics") -> DataFrame:
    """``docs`` with ``out_col``, an array of doubles, in place of ``text_col``."""
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches.chunks(batch, text_col):
                rows = pa.array([statistics(t or b"") for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept] + [rows], names=kept + [out_col])

    return docs.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- learning -------------------------------------------------------------------

def label_counts(labels: DataFrame, key_col: str, label_col: str) -> DataFrame:
    """(label_key, n0, n1): how often each key has either label."""
    return (labels.where(F.col(key_col).isNotNull())
            .groupBy(F.col(key_col).alias("label_key"))
            .agg(F.count(F.when(F.col(label_col) == 0, 1)).alias("n0"),
                 F.count(F.when(F.col(label_col) == 1, 1)).alias("n1")))


def moments(taught: DataFrame) -> dict[int, np.ndarray]:
    """Per class: the sum of (1, x, x x') over rows (statistics, n0, n1)."""
    d = len(STATISTICS)
    width = 1 + d + d * d

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in it:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                for c in (0, 1):
                    w = batch.column(1 + c).to_numpy().astype(float)
                    wx = x * w[:, None]
                    total[c] += np.concatenate(([w.sum()], wx.sum(axis=0), (wx.T @ x).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), 2)),
             pa.array(total.ravel())], names=["label", "place", "value"])

    parts = taught.select("statistics", "n0", "n1").mapInArrow(run, "label int, place int, value double")
    out = {0: np.zeros(width), 1: np.zeros(width)}
    for r in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        out[r.label][r.place] = r.value
    return out


@dataclass(frozen=True)
class Discriminant:
    """``center`` and ``scale`` standardise the statistics.  Per class: ``means``,
    ``whiten`` (the inverse Cholesky factor) and ``log_norm`` (half the log
    determinant).  ``constant`` is the score if there is no model."""

    log_odds: float = 0.0
    constant: float | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, ...] = ()
    whiten: tuple[np.ndarray, ...] = ()
    log_norm: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.center) / self.scale
        density = []
        for mean, whiten, log_norm in zip(self.means, self.whiten, self.log_norm):
            # einsum adds in the same order in every batch, unlike a matrix product
            away = np.einsum("ij,kj->ik", z - mean, whiten)
            density.append(-0.5 * (away * away).sum(axis=1) - log_norm)
        logit = (density[1] - density[0]) / x.shape[1] + self.log_odds
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fitted(sums: dict[int, np.ndarray], to_pooled: float = TO_POOLED,
           to_identity: float = TO_IDENTITY) -> Discriminant:
    """The discriminant of the ``moments`` of two classes."""
    d = len(STATISTICS)
    n = [float(sums[c][0]) for c in (0, 1)]
    if not all(n):
        return Discriminant(constant=0.5 if not any(n) else float(n[1] > 0))
    mean = [sums[c][1:1 + d] / n[c] for c in (0, 1)]
    cov = [sums[c][1 + d:].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    center = (n[0] * mean[0] + n[1] * mean[1]) / sum(n)
    spread = pooled + (n[0] * np.outer(mean[0] - center, mean[0] - center)
                       + n[1] * np.outer(mean[1] - center, mean[1] - center)) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(spread), 0)) + 1e-3
    whiten, log_norm = [], []
    for c in (0, 1):
        shrunk = ((1 - to_pooled) * cov[c] + to_pooled * pooled) / np.outer(scale, scale)
        even = max(np.trace(shrunk) / d, LEAST_VARIANCE)
        shrunk = (1 - to_identity) * shrunk + to_identity * even * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        log_norm.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(math.log(n[1] / n[0]), None, center, scale,
                        tuple((m - center) / scale for m in mean), tuple(whiten), tuple(log_norm))


def fit(stats: DataFrame, labels: DataFrame, key_col: str = "doc_id", label_col: str = "quality",
        to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Learn from all rows of ``stats`` (``key_col``, ``statistics``) that have a label."""
    counts = label_counts(labels, key_col, label_col)
    taught = stats.select(F.col(key_col).alias("stat_key"), "statistics").join(
        counts, F.col("stat_key") == F.col("label_key"))
    return fitted(moments(taught), to_pooled, to_identity)


# ---- scoring --------------------------------------------------------------------

def with_scores(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` with ``score`` and ``predicted`` in place of ``statistics``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in stats.columns if c not in ("statistics", "score", "predicted")]
    schema = T.StructType([stats.schema[c] for c in kept]
                          + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.schema.get_field_index
            score = shared.value.scores(_matrix(batch.column(at("statistics")))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(at(c)) for c in kept]
                + [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=kept + ["score", "predicted"])

    return stats.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows that must not teach: 5 divides the checksum of the key's text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """Learn from the labelled rows that are not held out and score every row:
    ``key_col``, ``held_out``, ``score``, ``predicted``."""
    rows = docs.select(F.col(key_col).alias("k"), held_out(F.col(key_col)).alias("held_out"), F.col(text_col).alias("t"))
    stats = cut_lineage(with_statistics(rows, "t"))
    teachers = labels.select(F.col(key_col).alias("k"), F.col(label_col).alias("label"))
    model = fit(stats.where(~F.col("held_out")), teachers, "k", "label")
    return with_scores(stats, model).withColumnRenamed("k", key_col)
