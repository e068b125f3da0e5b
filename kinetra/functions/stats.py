"""Exact small-sample statistics: for lists on the driver, and for all groups of a table at once."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXACT = 50  # pairs up to which the null distribution is counted out


def average_ranks(values: list[float]) -> list[float]:
    order = sorted(values)
    first, count = {}, Counter(order)
    for i, v in enumerate(order):
        first.setdefault(v, i)
    return [first[v] + (count[v] + 1) / 2 for v in values]


def wilcoxon(differences: list[float]) -> float | None:
    """Two-sided signed-rank p-value. Zeros are dropped; without zeros or ties and up to EXACT values the distribution is exact, else normal with the ties' correction and no continuity correction. None where nothing is left."""
    d = [x for x in differences if x]
    n = len(d)
    if not n:
        return None
    size = [abs(x) for x in d]
    ranks = average_ranks(size)
    up = sum(r for r, x in zip(ranks, d) if x > 0)
    low = min(up, n * (n + 1) / 2 - up)
    ties = Counter(size)
    if n == len(differences) and len(ties) == n and n <= EXACT:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties.values()) / 48
    z = (low - n * (n + 1) / 4) / math.sqrt(var)
    return min(1.0, math.erfc(-z / math.sqrt(2)))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: a power series below 3, a continued fraction from there on."""
    term = lambda k: F.when(k % 2 == 0, 1.0).otherwise(-1.0) * F.exp((2 * k + 1) * F.ln(x) - F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(k > 0, F.ln(i.cast("double"))).otherwise(0.0))) / (2 * k + 1)
    series = 1 - 2 / math.sqrt(math.pi) * F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.lit(0.0), lambda a, k: a + term(k))
    tail = F.exp(-x * x) / math.sqrt(math.pi) / F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda a, k: x + k / 2.0 / a)
    return F.when(x <= 0, 1.0).when(x < 3, series).otherwise(tail)


def signed_rank(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """A row for each group: keys, n, a_lower, ties, a_higher, mean_difference (a - b), p_value as by wilcoxon(); rows with a null on either side are left out, and p_value is null where all differences are 0.

    Equal differences are counted before anything is ordered. The exact distribution is a fold over the ranks: each rank
    either adds to the sum or does not. Nothing is collected; a group's distinct sizes of difference are ordered by one task.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a).cast("double") - F.col(b).cast("double"))
    counts = d.groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_d") > 0).alias("_up"), F.sum("_d").alias("_sum"))
    some = F.col("_size") > 0
    w = W.partitionBy(*keys).orderBy("_size")
    before = F.sum(F.when(some, F.col("_c")).otherwise(0)).over(w) - F.col("_c")
    ranked = counts.withColumn("_rank", F.when(some, before + (F.col("_c") + 1) / 2.0))
    g = ranked.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.coalesce(F.sum(F.when(some, F.col("_c") - F.col("_up"))), F.lit(0)).alias("a_lower"), F.coalesce(F.sum(F.when(~some, F.col("_c"))), F.lit(0)).alias("ties"), F.sum("_up").alias("a_higher"),
        (F.sum("_sum") / F.sum("_c")).alias("mean_difference"), F.sum(F.col("_rank") * F.col("_up")).alias("_w"), F.sum(F.when(some, F.pow("_c", F.lit(3)) - F.col("_c"))).alias("_tied"),
    )
    m = F.col("n") - F.col("ties")
    every = m * (m + 1) / 2.0
    low = F.least(F.col("_w"), every - F.col("_w"))
    zero = F.transform(F.sequence(F.lit(0), F.least(every, F.lit(EXACT * (EXACT + 1) // 2)).cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    add = lambda ways, r: F.transform(ways, lambda x, s: x + F.when(s >= r, F.get(ways, s - r)).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), m.cast("int")), zero, add)
    exact = 2 * F.aggregate(F.slice(ways, F.lit(1), low.cast("int") + 1), F.lit(0.0), lambda acc, x: acc + x) / F.pow(F.lit(2.0), m)
    z = (every / 2 - low) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - F.col("_tied") / 48.0)
    by_count = (F.col("ties") == 0) & (F.col("_tied") == 0) & (m <= EXACT)
    p = F.when(m > 0, F.least(F.lit(1.0), F.when(by_count, exact).otherwise(erfc(z / math.sqrt(2)))))
    return g.select(*keys, "n", "a_lower", "ties", "a_higher", "mean_difference", p.alias("p_value"))
