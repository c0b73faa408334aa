"""Operator 6, quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each whole text are taken in Arrow batches. Class sums, means and covariances come from one Spark aggregation over
all labelled training rows, so no rows reach the driver; it gets one row of moments per class. Each class covariance is shrunk
towards the pooled one and then towards its own diagonal, and its Cholesky factor is computed once and used for every score.

Nulls and edge cases: a null text counts as empty; empty texts are scored too. Rows of the input with a null key, repeated rows and
extra columns are kept as they are by with_score(), whatever their names; quality_scores() drops them. A label that is null is not learned from; several labels of one key all count. With no
labelled rows, or with one class only, the score is the share of label 1 among them (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

STATISTICS = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "space", "line", "distinct_words", "longest_run", "repeated_lines", "letters_spread")
#: Weight of the pooled covariance, of the own diagonal, and the least variance of a transformed statistic.
POOL, IDENTITY, FLOOR = 0.3, 0.05, 1e-3
THRESHOLD = 0.3


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
    out[[ord(c) for c in "!?|*#$%&"]] = 4
    out[[32, 9, 11, 12, 13]] = 5
    out[10] = 6
    return out


def statistics(text: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text: counts as logs, shares as square roots, all bounded."""
    data, offsets = K.raw(text)
    n = len(text)
    size = np.diff(offsets)
    kind = _byte_classes()[data]
    counts = np.zeros((7, n))
    for k in range(1, 7):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts[k] = np.diff(total[offsets])
    starts, ends, first = K.word_spans(data, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    hashes = K.span_hashes(K.byte_values(True)[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    distinct = _distinct(row, hashes, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[same], minlength=n)
    cut = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([cut + 1, offsets[:-1]]))
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    lines = K.span_hashes(K.byte_values(False)[data], cut, stop) if len(cut) else np.zeros(0, np.uint64)
    owner = np.searchsorted(offsets, cut, "right") - 1
    n_lines = np.bincount(owner, minlength=n)
    unique_lines = _distinct(owner, lines, n)
    some, w = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda x, of: np.sqrt(x / of)
    return np.column_stack([
        np.log1p(words) / 4, np.log1p((size - counts[5] - counts[6]) / w), share(counts[1], some), share(counts[2], some), share(counts[3], some), share(counts[4], some),
        share(counts[5], some), share(counts[6], some), distinct / (w**0.9), share(repeats, w), share(n_lines - unique_lines, np.maximum(n_lines, 1)), np.log1p(counts[1] / w),
    ])


def _distinct(row: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    if not len(keys):
        return np.zeros(n)
    order = np.argsort(K.mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    r, k = row[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, and x: the statistics of text."""
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.slices(batch, "__text"):
                x = statistics(text)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=[*keep, "x"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve factor @ z = b for a lower triangular factor, row by row over all columns of b at once."""
    z = np.empty_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Model:
    """Means, Cholesky factors and log-density constants by class; share: of label 1 in training."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        density = np.empty((2, len(x)))
        for k in (0, 1):
            z = forward(self.factors[k], (x - self.means[k]).T)
            density[k] = self.constants[k] - 0.5 * (z * z).sum(axis=0)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame, label: str = "label", pool: float = POOL, identity: float = IDENTITY, floor: float = FLOOR) -> Model:
    """Fit on rows with x and a 0/1 label: one aggregation of first and second moments by class."""
    d = len(STATISTICS)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = {int(r["y"]): r for r in rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    n = np.array([got[k]["n"] if k in got else 0 for k in (0, 1)], float)
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if not n.all():
        return Model(share)
    means, covariances = [], []
    for k in (0, 1):
        m = np.array([got[k][f"s{i}"] for i in range(d)]) / n[k]
        c = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                c[i, j] = c[j, i] = got[k][f"p{i}_{j}"] / n[k] - m[i] * m[j]
        means.append(m)
        covariances.append(c)
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - pool) * covariances[k] + pool * pooled
        c = (1 - identity) * c + identity * np.diag(np.maximum(np.diag(c), floor)) + floor * np.eye(d)
        f = np.linalg.cholesky(c)
        factors.append(f)
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum())
    return Model(share, np.array(means), np.array(factors), np.array(constants))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves no rest by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The discriminant, learned from all labelled rows that aren't held out."""
    marks = labels.select(F.col("doc_id").alias("__key"), F.col(label).alias("label")).where("label is not null")
    # moments need only short rows of statistics: texts are read where they lie and never shuffled
    train = with_statistics(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), ["doc_id"])
    return fit(train.join(marks, F.col("doc_id") == F.col("__key")))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs' columns as they are, whatever their names, and one more: the model's score of text."""
    columns, inside = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    text = columns.index("text")
    schema = T.StructType([*(T.StructField(i, f.dataType) for i, f in zip(inside, docs.schema, strict=True)), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in K.slices(batch, inside[text]):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(statistics(texts)))], names=schema.names)

    return docs.toDF(*inside).mapInArrow(run, schema).toDF(*columns, name)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (score >= threshold) for each row of docs."""
    scored = with_score(docs.select("doc_id", "text"), quality_model(docs, labels, label))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
