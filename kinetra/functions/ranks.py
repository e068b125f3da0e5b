"""Running sums and ranks over a whole table without a single ordering task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: str, value: str, alias: str, buckets: int = 64) -> DataFrame:
    """df with alias: the sum of value over all rows up to and with the row's order (distinct numbers), and alias_total.

    Approximate quantiles of order (at most `buckets` numbers) cut the table into ranges; each range sums on its own and
    starts from the total of the ranges before it, a table of at most `buckets` + 1 rows.
    """
    bounds = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    cuts = F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))).cast("array<double>")
    part = df.withColumn("_part", F.size(F.filter(cuts, lambda c: c < F.col(order))))
    totals = part.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = totals.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias(f"{alias}_total"))
    within = F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return part.join(F.broadcast(offsets), "_part").withColumn(alias, within + F.col("_before")).drop("_part", "_before")


def average_rank(df: DataFrame, column: str, alias: str) -> DataFrame:
    """df with alias: the average rank of column from 1, and alias_n: the number of rows. Rows whose column is null stay, without a rank, and are not counted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sum(counts, "_v", "_c", "_up").select("_v", (F.col("_up") - (F.col("_c") - 1) / 2.0).alias(alias), F.col("_up_total").alias(f"{alias}_n"))
    return df.join(ranked, F.col(column) == F.col("_v"), "left").drop("_v")
