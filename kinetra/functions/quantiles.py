"""Exact quantiles of a whole table: ranks are narrowed down by counting in value ranges, no task sorts more than a range."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048  # ranges that a pass counts, for each rank
FETCH = 20_000  # values of a range that are looked at one by one (the least of them are enough)


@dataclass
class _Rank:
    """The value with `place` (from 0) among those within lo..hi."""

    place: int
    lo: float
    hi: float
    n: int
    value: float | None = None


def order_statistics(df: DataFrame, column: str, places: list[int], known: tuple[int, float, float] | None = None) -> list[float]:
    """The values with the given places (from 0) in ascending order; nulls and NaN are left out. known: number, least and greatest value, where the caller has them.

    Each pass counts the values of every open rank's range in BUCKETS parts, with the least and the greatest value of each
    part, so a range of one value, however often it occurs, ends the search. A range of at most FETCH values is read. Where
    equal parts hardly split a range (values of many orders of magnitude), _bracket() does.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, lo, hi = known or values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    ranks = [_Rank(p, lo, hi, n) for p in places]
    for r in ranks:
        if r.lo == r.hi:
            r.value = r.lo
    while True:
        open_ = [r for r in ranks if r.value is None]
        if not open_:
            return [r.value for r in ranks]
        small = [r for r in open_ if r.n <= FETCH]
        ranges = {(r.lo, r.hi) for r in small}
        found: dict[tuple[float, float], list[float]] = {k: [] for k in ranges}
        if ranges:
            within = [F.col("v").between(a, b) for a, b in ranges]
            some = within[0]
            for w in within[1:]:
                some = some | w
            got = sorted(x["v"] for x in values.where(some).collect())  # FETCH a rank at most
            for a, b in ranges:
                found[a, b] = [v for v in got if a <= v <= b]
            for r in small:
                r.value = found[r.lo, r.hi][r.place]
            continue
        spans = sorted({(r.lo, r.hi) for r in open_})
        # Halves, so that the width of a range of great values of both signs is still a number.
        bucket = lambda a, b: F.least(F.floor((F.col("v") / 2 - a / 2) / ((b / 2 - a / 2) / BUCKETS)), F.lit(BUCKETS - 1))
        at = [F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), bucket(a, b).alias("b"))) for k, (a, b) in enumerate(spans)]
        hit = values.select("v", F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias("x"))
        table = hit.groupBy("x.k", "x.b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "b").collect()
        for r in open_:
            k, left, before = spans.index((r.lo, r.hi)), r.place, r.n
            for row in (x for x in table if x["k"] == k):
                if left < row["c"]:
                    r.place, r.lo, r.hi, r.n = left, row["lo"], row["hi"], row["c"]
                    break
                left -= row["c"]
            if r.lo != r.hi and r.n > max(FETCH, before / 8):
                _bracket(values, r)
            if r.lo == r.hi:
                r.value = r.lo


def _bracket(values: DataFrame, r: _Rank, margin: float = 1e-3) -> None:
    """Narrow a rank's range to the values that a sketch has within `margin` on either side of it, counted exactly."""
    inside, at = values.where(F.col("v").between(r.lo, r.hi)), r.place / max(r.n - 1, 1)
    lo, hi = inside.agg(F.percentile_approx("v", [max(at - margin, 0.0), min(at + margin, 1.0)], 10_000)).first()[0]
    below, held = inside.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi))).first()
    if below <= r.place < below + held:
        r.place, r.lo, r.hi, r.n = r.place - below, lo, hi, held


def quantiles(df: DataFrame, column: str, qs: list[float], known: tuple[int, float, float] | None = None) -> list[float | None]:
    """Exact quantiles, linearly interpolated between neighbouring values; None without values. Two or three passes over df, so hand over a written table."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    known = known or tuple(values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first())
    n = known[0]
    if not n:
        return [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    places = [p for x in at for p in (math.floor(x), math.ceil(x))]
    v = order_statistics(values, "v", places, known)
    return [a + (x - math.floor(x)) * (b - a) for x, a, b in zip(at, v[::2], v[1::2])]


def grouped_medians(df: DataFrame, keys: list[str], column: str, alias: str, most: int = 1_000_000) -> DataFrame:
    """keys, alias: the exact median of each group. Groups of up to `most` rows are sorted by one task each; greater ones go through quantiles(), so no task holds one."""
    big = df.groupBy(*keys).count().where(F.col("count") > most).select(*keys).collect()  # at most a group for each `most` rows
    if not big:
        return df.groupBy(*keys).agg(F.median(column).alias(alias))
    spark = df.sparkSession
    is_ = lambda r: [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]
    rows = []
    for r in big:
        one = df
        for c in is_(r):
            one = one.where(c)
        rows.append((*r, quantiles(one, column, [0.5])[0]))
    schema = df.select(*keys).schema.add(alias, "double")
    great = spark.createDataFrame(rows, schema)
    rest = df
    for r in big:
        same = F.lit(True)
        for c in is_(r):
            same = same & c
        rest = rest.where(~same)
    return rest.groupBy(*keys).agg(F.median(column).alias(alias)).unionByName(great)
