"""Kinematic features of episodes and their difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DIFFICULTY_WEIGHTS, SCALINGS, one_of
from ..functions.ranks import average_rank

FEATURES = ("duration", "path_length", "net_displacement", "tortuosity", "log_tortuosity", "mean_speed", "max_speed", "rms_acceleration", "rms_jerk", "normalized_jerk", "log_normalized_jerk", "reversal_rate", "workspace_span")


def differences(frames: DataFrame) -> DataFrame:
    """frames with first, second and third differences of x, y, z (dx, ddx, dddx, ...), by one window over each episode."""
    w = W.partitionBy("idx").orderBy("frame")
    for c in "xyz":
        p1, p2, p3 = (F.lag(c, k).over(w) for k in (1, 2, 3))
        frames = frames.withColumns({f"d{c}": F.col(c) - p1, f"dd{c}": F.col(c) - 2 * p1 + p2, f"ddd{c}": F.col(c) - 3 * p1 + 3 * p2 - p3})
    return frames


def _square(p: str) -> Column:
    return F.col(f"{p}x") * F.col(f"{p}x") + F.col(f"{p}y") * F.col(f"{p}y") + F.col(f"{p}z") * F.col(f"{p}z")


def features(frames: DataFrame) -> DataFrame:
    """idx and the 13 FEATURES of each episode of frames (idx, frame, x, y, z, dt).

    One shuffle by episode: the windows and the aggregation share it. Episodes of fewer than 2, 3 or 4 frames have zeros
    where a feature needs more; tortuosity is then 1.
    """
    d = differences(frames)
    step = F.sqrt(_square("d"))
    w = W.partitionBy("idx").orderBy("frame")
    # Direction cosines are between moving steps that follow one another once standing ones are left out.
    moving = step > 1e-12
    last = [F.last(F.when(moving, F.col(f"d{c}")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)) for c in "xyz"]
    d = d.withColumns({"step": step, "turn": F.when(moving, sum((F.col(f"d{c}") * p for c, p in zip("xyz", last)), F.lit(0.0)))})
    g = d.groupBy("idx").agg(
        F.count(F.lit(1)).cast("double").alias("duration"), F.max("dt").alias("dt"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        *(F.min_by(c, "frame").alias(f"{c}0") for c in "xyz"), *(F.max_by(c, "frame").alias(f"{c}1") for c in "xyz"), *((F.max(c) - F.min(c)).alias(f"{c}r") for c in "xyz"),
        F.avg("step").alias("step_mean"), F.max("step").alias("step_max"), F.avg(_square("dd")).alias("acc2"), F.avg(_square("ddd")).alias("jerk2"), F.sum(_square("ddd")).alias("jerk_sum"),
        F.count("turn").alias("turns"), F.count_if(F.col("turn") < 0).alias("back"),
    )
    n, length, dt = F.col("duration"), F.col("path_length"), F.col("dt")
    hyp = lambda a, b: F.sqrt(sum(((F.col(f"{c}{a}") - (F.col(f"{c}{b}") if b else 0)) ** 2 for c in "xyz"), F.lit(0.0)))
    net = hyp("1", "0")
    tortuosity = F.when(n < 2, 1.0).otherwise(length / F.greatest(net, length * 1e-4, F.lit(1e-12)))
    jerk = F.when((n >= 4) & (length > 1e-12), F.sqrt(F.col("jerk_sum") / F.pow(dt, 6) * dt * F.pow(n * dt, 5) / (length * length))).otherwise(0.0)
    zero = F.lit(0.0)
    out = {
        "duration": n, "path_length": length, "net_displacement": F.when(n < 2, 0.0).otherwise(net), "tortuosity": tortuosity, "log_tortuosity": F.when(n < 2, 0.0).otherwise(F.log1p(tortuosity)),
        "mean_speed": F.coalesce(F.col("step_mean") / dt, zero), "max_speed": F.coalesce(F.col("step_max") / dt, zero),
        "rms_acceleration": F.coalesce(F.sqrt("acc2") / F.pow(dt, 2), zero), "rms_jerk": F.coalesce(F.sqrt("jerk2") / F.pow(dt, 3), zero),
        "normalized_jerk": jerk, "log_normalized_jerk": F.log1p(jerk), "reversal_rate": F.when(F.col("turns") > 0, F.col("back") / F.col("turns")).otherwise(0.0),
        "workspace_span": F.when(n < 2, 0.0).otherwise(hyp("r", "")),
    }
    return g.select("idx", *(c.alias(k) for k, c in out.items()))


def robust_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with z_<column>: (v - median) / (1.4826 MAD); where the MAD vanishes by mean and population deviation, and 0 where that vanishes too. Two small aggregations, broadcast as one row each."""
    centre = df.agg(*(F.median(c).alias(f"_med_{c}") for c in columns), *(F.avg(c).alias(f"_avg_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_std_{c}") for c in columns))
    with_centre = df.join(F.broadcast(centre))
    spread = with_centre.agg(*(F.median(F.abs(F.col(c) - F.col(f"_med_{c}"))).alias(f"_mad_{c}") for c in columns))
    both = with_centre.join(F.broadcast(spread))

    def z(c: str) -> Column:
        mad, std = F.col(f"_mad_{c}"), F.col(f"_std_{c}")
        return F.when(mad >= 1e-12, (F.col(c) - F.col(f"_med_{c}")) / (1.4826 * mad)).when(std >= 1e-12, (F.col(c) - F.col(f"_avg_{c}")) / std).otherwise(0.0)

    return both.select(*df.columns, *(z(c).alias(f"z_{c}") for c in columns))


def rank_scale(df: DataFrame, column: str, alias: str) -> DataFrame:
    """alias: (average rank - 1) / (n - 1); 0 where all are equal or there is one row.

    Ranks come from counts by value, so that ties are aggregated before values are ordered.
    """
    ends = df.agg((F.max(column) - F.min(column)).alias("_range"))
    ranked = average_rank(df, column, "_rank").join(F.broadcast(ends))
    return ranked.withColumn(alias, F.when((F.col("_rank_n") < 2) | (F.col("_range") < 1e-12), 0.0).otherwise((F.col("_rank") - 1) / (F.col("_rank_n") - 1))).drop("_rank", "_rank_n", "_range")


def difficulty(feats: DataFrame, weights: dict[str, float] | None = None, scaling: str = "rank") -> DataFrame:
    """feats with difficulty_z (weighted mean of robust z-scores; features that are not there are skipped) and difficulty in 0..1."""
    one_of("scaling", scaling, SCALINGS)
    weights = {k: w for k, w in (weights or DIFFICULTY_WEIGHTS).items() if k in feats.columns}
    total = sum(abs(w) for w in weights.values())
    if not total:
        raise ValueError("no feature with a weight is there")
    z = robust_z(feats.persist(), list(weights))  # a row an episode, used by each of the passes below
    z = z.withColumn("difficulty_z", sum((F.col(f"z_{k}") * w for k, w in weights.items()), F.lit(0.0)) / total).drop(*(f"z_{k}" for k in weights)).persist()
    if scaling == "rank":
        # Rounded keys: equal episodes are ties whatever the order of summation.
        return rank_scale(z.withColumn("_key", F.round("difficulty_z", 9)), "_key", "difficulty").drop("_key")
    ends = z.agg(F.min("difficulty_z").alias("_lo"), F.max("difficulty_z").alias("_hi"))
    return z.join(F.broadcast(ends)).withColumn("difficulty", F.when(F.col("_hi") - F.col("_lo") < 1e-12, 0.0).otherwise((F.col("difficulty_z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")
