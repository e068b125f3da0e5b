"""Embedding whitening: principal components of integer-valued vectors by MLlib's distributed decomposition.

Vectors become whole numbers, so that sums and deviations are exact at any order of adding. Rows are centred before
anything is multiplied; MLlib adds up their products over all executors and decomposes what comes out (one number a pair
of dimensions, whatever the number of rows). Singular values s of the centred rows give the covariance's eigenvalues
s * s / n; the total variance comes from the exact deviations instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 1024.0, 100_000
LARGEST = float(1 << 40)  # the largest entry that is taken


def whole(entry: Column) -> Column:
    """An entry as a whole number."""
    return F.floor(F.lit(SCALE) * entry) + F.lit(SHIFT).cast("long")


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and c (array of double) of rows whose vector has entries, none of them null or not finite, and the most common length (the longer of two)."""
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    fine = vectors.where(F.col(column).isNotNull() & finite & (F.size(column) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c"))
    size = fine.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return fine.where(F.size("c") == (size["size"] if size else 0))


def _exact(d: np.ndarray) -> list[Decimal]:
    """Sums of squares of the rows of a table of whole numbers, exact."""
    if not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62:
        return [Decimal(int(v)) for v in (d * d).sum(axis=1)]
    return [Decimal(sum(v * v for v in row)) for row in d.tolist()]


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 8, rcond: float = 1e-6) -> DataFrame:
    """A row for each usable row of vectors (vec_id, column) and component: vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal: sum over dimensions of (n * x - S) ** 2, exact), whitened, explained, identity_error.

    Rows with a null vector, an empty one, null or non-finite entries are left out, as are those of another length than
    most rows have; entries over 2**40 are an error. Repeated rows count as often as they occur; vec_id may be null. At
    most `most` components, fewer where there are fewer dimensions; directions whose singular value is below rcond times
    the largest have no variance to scale to 1 and are no components, so equal rows, one row or none give no result rows.
    A component's largest entry (the first of equals) is positive. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, column)
    empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    entries, held = rows.select(F.posexplode("c").alias("pos", "e")), F.abs("e") <= LARGEST
    sums = entries.groupBy("pos").agg(F.sum(F.when(held, whole(F.col("e")))).alias("s"), F.count(F.lit(1)).alias("n"), F.bool_and(held).alias("held")).orderBy("pos").collect()  # a row a dimension
    if not sums:
        return spark.createDataFrame([], empty)
    if not all(r["held"] for r in sums):
        raise ValueError("an entry is over 2**40")
    n, total = sums[0]["n"], [r["s"] for r in sums]
    rows = rows.select("vec_id", F.transform("c", whole).alias("x"))
    centred = F.zip_with("x", F.lit(total), lambda x, s: (x * F.lit(n) - s) / F.lit(float(n)))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v"))
    if n < 2 or not matrix.computeColumnSummaryStatistics().variance().any():
        return spark.createDataFrame([], empty)
    svd = matrix.computeSVD(len(total), False, rcond)  # all of them: fewer go through an iteration that stops at 1e-10
    values, axes = svd.s.toArray()[:most] ** 2 / n, svd.V.toArray()[:, :most]
    axes = axes / np.linalg.norm(axes, axis=0)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    scaled, k, sum_ = axes / np.sqrt(values), len(values), np.array(total, np.int64)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sum_))
            d = x * n - sum_
            w = (d / n) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_exact(d), pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    out = materialize(rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), w array<double>"), "whitened")
    w = [F.col("w")[i] for i in range(k)]
    errors = [F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    stats = out.agg(F.sum("deviation").alias("sum"), F.array_max(F.array(*errors)).alias("error")).first()
    trace = Fraction(int(stats["sum"]), n**3)
    explained = [float(Fraction(float(v)) / trace) for v in values]
    return out.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained)[F.col("c")].alias("explained"), F.lit(float(stats["error"])).alias("identity_error"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
