"""Cleaning of raw poses: padding, lost frames, units, standing arms, choice of arm, and the ledger of rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import UNLABELLED, CleanConfig


def missing() -> Column:
    """A frame is lost where x, y and z are all exactly zero, or any of them is not finite."""
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return bad | ((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0))


def arm_quality(poses: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """A row for each episode and arm of poses (episode_id, arm, frame, x, y, z, total_frames): n_raw, n_valid,
    missing_frame_ratio, unit_scale, activity, and reason (null: usable).

    Padding is cut where total_frames is positive and not beyond the frames stored. Tests run in this order: lost frames,
    length, movement (after scaling). One shuffle by episode and arm serves the windows and the aggregation.
    """
    by = W.partitionBy("episode_id", "arm")
    stored = F.count(F.lit(1)).over(by)
    n = F.col("total_frames")
    kept = poses.withColumn("_stored", stored).where(~((n > 0) & (n <= F.col("_stored"))) | (F.col("frame") < n) | n.isNull()).drop("_stored").withColumn("_lost", missing())
    ordered = by.orderBy("frame")
    for c in "xyz":
        kept = kept.withColumn(f"_p{c}", F.last(F.when(~F.col("_lost"), F.col(c)), ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1)))
    step = F.sqrt(sum(((F.col(c) - F.col(f"_p{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    ok = ~F.col("_lost")
    norm = F.sqrt(sum((F.col(c) ** 2 for c in "xyz"), F.lit(0.0)))
    g = kept.groupBy("episode_id", "arm").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(ok).alias("n_valid"), F.median(F.when(ok, norm)).alias("_norm"),
        F.greatest(*(F.stddev_pop(F.when(ok, F.col(c))) for c in "xyz")).alias("_std"), F.coalesce(F.sum(F.when(ok, step)), F.lit(0.0)).alias("_path"),
    )
    scale = F.when(F.col("_norm") > cfg.unit_limit, 1e-3).otherwise(1.0) if cfg.unit_scale == "auto" else F.lit(float(cfg.unit_scale))
    g = g.withColumns({"missing_frame_ratio": F.round(1 - F.col("n_valid") / F.col("n_raw"), 4), "unit_scale": scale})
    lost = 1 - F.col("n_valid") / F.col("n_raw")
    reason = (
        F.when(lost > cfg.max_missing, F.format_string("%.0f%% of frames are sentinels", lost * 100))
        .when(F.col("n_valid") < cfg.min_length, F.format_string("only %d valid frames", "n_valid"))
        .when(F.col("_std") * F.col("unit_scale") < cfg.static_std, "static arm")
    )
    return g.select("episode_id", "arm", "n_raw", "n_valid", "missing_frame_ratio", "unit_scale", (F.col("_path") * F.col("unit_scale")).alias("activity"), reason.alias("reason"))


def choose_arm(quality: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """A row an episode: arm_used (null: rejected), arms_available, and reason (of a rejection).

    auto takes the usable arm with the most activity, left first among equals; left and right are forced; both needs both.
    Any other arm name is a fallback, taken in order of name only where neither left nor right is usable.
    """
    usable, hand = F.col("reason").isNull(), F.col("arm").isin("left", "right")
    rank = F.struct(F.when(hand, 0).otherwise(1), F.when(hand, -F.col("activity")).otherwise(0.0), "arm")
    g = quality.groupBy("episode_id").agg(
        F.min_by(F.when(usable, F.col("arm")), F.when(usable, rank)).alias("best"), F.array_sort(F.collect_set(F.when(usable, F.col("arm")))).alias("arms_available"),
        F.array_join(F.array_sort(F.collect_set(F.when(~usable, F.concat_ws(": ", "arm", "reason")))), "; ").alias("why"),
    )
    has = lambda a: F.array_contains("arms_available", a)
    used = {"auto": F.col("best"), "left": F.when(has("left"), "left"), "right": F.when(has("right"), "right"), "both": F.when(has("left") & has("right"), "both")}[cfg.arm]
    return g.select("episode_id", used.alias("arm_used"), F.array_join("arms_available", ",").alias("arms_available"), F.when(used.isNull(), F.when(F.col("why") == "", "requested arm is not usable").otherwise(F.col("why"))).alias("reason"))


def clean(poses: DataFrame, cfg: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frames (episode_id, frame, x, y, z[, x2, y2, z2]), episodes (metadata with dense idx by episode_id) and skipped (episode_id, reason)."""
    quality = arm_quality(poses, cfg)
    chosen = choose_arm(quality, cfg)
    used = chosen.where("arm_used IS NOT NULL")
    arms = used.select("episode_id", F.explode(F.when(F.col("arm_used") == "both", F.array(F.lit("left"), F.lit("right"))).otherwise(F.array("arm_used"))).alias("arm"))
    scale = quality.select("episode_id", "arm", "unit_scale", "n_raw", "n_valid", "missing_frame_ratio").join(arms, ["episode_id", "arm"])
    meta = scale.groupBy("episode_id").agg(F.min_by("unit_scale", "arm").alias("unit_scale"), F.min("n_raw").alias("n_raw_frames"), F.min("n_valid").alias("n_valid_frames"), F.max("missing_frame_ratio").alias("missing_frame_ratio"))
    episodes = used.drop("reason").join(meta, "episode_id").withColumn("source", source_of(F.col("episode_id"))).withColumn("idx", F.row_number().over(W.orderBy("episode_id")) - 1)
    n, by = F.col("total_frames"), W.partitionBy("episode_id", "arm")
    good = poses.withColumn("_stored", F.count(F.lit(1)).over(by)).where(((~((n > 0) & (n <= F.col("_stored"))) | (F.col("frame") < n)) | n.isNull()) & ~missing())
    good = good.withColumn("_at", F.row_number().over(by.orderBy("frame")) - 1).join(arms, ["episode_id", "arm"]).join(episodes.select("episode_id", "unit_scale", "arm_used"), "episode_id")
    scaled = good.select("episode_id", "arm", F.col("_at").alias("frame"), *((F.col(c) * F.col("unit_scale")).alias(c) for c in "xyz"))
    if cfg.arm == "both":  # the arms side by side, as long as the shorter
        right = scaled.where("arm = 'right'").select("episode_id", "frame", *(F.col(c).alias(f"{c}2") for c in "xyz"))
        return scaled.where("arm = 'left'").drop("arm").join(right, ["episode_id", "frame"]), episodes, chosen.where("arm_used IS NULL").select("episode_id", "reason")
    return scaled.drop("arm"), episodes, chosen.where("arm_used IS NULL").select("episode_id", "reason")


def source_of(episode_id: Column) -> Column:
    """What stands before the first double underscore; unknown without one."""
    return F.when(F.instr(episode_id, "__") > 0, F.substring_index(episode_id, "__", 1)).otherwise("unknown")


def episode_of(store: Column) -> Column:
    """A store's name without its suffix, however often repeated."""
    return F.regexp_replace(store, r"(?:\.zarr)+$", "")


def labelled(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin(*UNLABELLED)


def rejection_kinds(skipped: DataFrame) -> DataFrame:
    """How many rejections name each kind of cause; one reason may name several."""
    rules = {"sentinel": "(?i)sentinel|missing", "static": "(?i)static", "short": "(?i)valid frames|short"}
    kinds = F.array_compact(F.array(*(F.when(F.col("reason").rlike(p), F.lit(k)) for k, p in rules.items())))
    return skipped.select(F.explode(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("other")))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def is_human(embodiment: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(embodiment, F.lit("")), source).rlike("(?i)human|hand|person")


def in_tasks(df: DataFrame, tasks: list[str]) -> DataFrame:
    """Rows of these tasks; all for an empty list; an error where none is left."""
    if not tasks:
        return df
    out = df.where(F.col("task_name").isin(*tasks))
    if out.isEmpty():
        raise ValueError("no episode has one of these tasks")
    return out
