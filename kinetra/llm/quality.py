"""Quality classifier: regularised quadratic discriminant analysis on statistics of a text.

Both classes get a Gaussian with a covariance shrunk towards a pooled diagonal; a score is the difference of the two log
densities, each from a Mahalanobis distance over a cached Cholesky factor, put through a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, materialize, may_be_in, release

FEATURES = ("words", "word_len", "symbols", "upper", "variety", "stops", "line_len", "line_repeat", "word_repeat", "digits", "bars", "short", "exclaim")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{}~|/"]] = True


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, each of the order of 1. A text without words has fixed values."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(c[65:91].sum() + c[97:123].sum() + c[194:245].sum())
    size = len(raw) - int(c[128:192].sum())  # code points
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(n) / 4,
        np.log((size - n + 1) / n + 0.5),
        np.sqrt(c[_SYMBOL].sum() / size) * 4,
        np.sqrt(c[65:91].sum() / max(letters, 1)) * 2,
        np.log(len(set(words)) / n) + np.log1p(n) / 8,
        np.sqrt((c[44] + c[46]) / n),
        np.log(n / max(len(lines), 1) + 1) / 2,
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)) * 2,
        np.sqrt(sum(map(eq, words, words[1:])) / n) * 3,
        np.sqrt(c[48:58].sum() / size) * 4,
        np.sqrt(c[124] / n) * 2,
        np.sqrt(sum(len(w) <= 3 for w in words) / n) * 2,
        np.sqrt(c[33] / n) * 2,
    ]


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["doc_id", *FEATURES])
    release()


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text (null: empty)."""
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    inverse: np.ndarray  # of the Cholesky factor
    constant: float  # log prior and log determinant

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.constant - 0.5 * (z * z).sum(axis=1)


@dataclass(frozen=True)
class Model:
    """bad and good are the two classes; the score is 1 / (1 + exp(-slope * (log density of good - that of bad)))."""

    bad: Gaussian | None
    good: Gaussian | None
    slope: float
    share: float  # of label 1; the score where a class has no rows to learn from

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.bad is None or self.good is None:
            return np.full(len(x), self.share)
        gap = np.clip(self.slope * (self.good.log_density(x) - self.bad.log_density(x)), -500, 500)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame, shrinkage: float = 0.1, floor: float = 0.02, slope: float = 0.25) -> Model:
    """Fit on rows (statistics, label 0/1). Only sums leave the executors: for each class the count, the sums and the sums of products, whatever the number of rows.

    shrinkage moves each covariance towards the diagonal of the pooled one; floor is the least variance of a statistic.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(f) for f in FEATURES)).alias("s"), F.array(*(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs)).alias("q"))
    by = {r["label"]: r for r in sums.collect()}
    total = sum(r["n"] for r in by.values())
    share = by[1]["n"] / total if 1 in by else 0.0 if by else 0.5
    if len(by) < 2:
        return Model(None, None, slope, share)
    mean, cov = {}, {}
    for k, r in by.items():
        mean[k] = np.array(r["s"]) / r["n"]
        cov[k] = np.zeros((d, d))
        for (i, j), q in zip(pairs, r["q"]):
            cov[k][i, j] = cov[k][j, i] = q / r["n"] - mean[k][i] * mean[k][j]
    pooled = np.diag(sum(np.diag(cov[k]) * by[k]["n"] for k in by) / total)

    def gaussian(k: int) -> Gaussian:
        low = np.linalg.cholesky((1 - shrinkage) * cov[k] + shrinkage * pooled + floor * np.eye(d))
        return Gaussian(mean[k], np.linalg.inv(low), float(np.log(by[k]["n"] / total) - np.log(np.diag(low)).sum()))

    return Model(gaussian(0), gaussian(1), slope, share)


def apply(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", *FEATURES).mapInArrow(run, "doc_id long, score double")


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the id's decimal text, modulo 5; -1 where there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, held_out, score in 0..1, predicted.

    Learns from labels (doc_id, quality) of rows whose fold is not 0; nothing but the text enters a score. Null and empty
    texts have the statistics of a text without words. A row without doc_id is scored, never learned from and not held
    out. Repeated label rows weigh as often as they occur; null or other labels than 0 and 1 are left out. With labels of
    one class alone every score is that class's share, with none 0.5. Other columns are ignored.
    """
    stats = materialize(features(docs), "quality-features")
    known = labels.selectExpr("cast(doc_id as long) AS doc_id", "cast(quality as int) AS label").where("label IN (0, 1)")
    model = fit(stats.where(fold(F.col("doc_id")) > 0).join(known, "doc_id"))
    return apply(stats, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted as label 0 go. The model is fitted as in op7; the rows are scored where they lie, so no join is needed."""
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("cast(doc_id as long) AS doc_id", "cast(quality as int) AS label").where("label IN (0, 1)")
    labelled = may_be_in(docs.select("doc_id", "text"), F.col("doc_id").cast("long"), bit_filter(known, "doc_id"))
    stats = materialize(features(labelled.where(fold(F.col("doc_id")) > 0)), "quality-features")
    model = fit(stats.join(known, "doc_id"))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.3))
        release()

    return docs.mapInArrow(run, docs.schema)
