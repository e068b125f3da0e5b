"""The training-order experiment: windows, splits, orders, a small network, and what the runs add up to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ORDERINGS, TrainConfig, one_of
from ..functions.stats import wilcoxon


def windows(trajectories: DataFrame, window: int = 16, horizon: int = 1) -> DataFrame:
    """idx, at, x (3 * window numbers: positions less the window's last), y (3: what comes `horizon` later, less the same) of trajectories (idx, traj)."""
    flat = trajectories.where(F.size("traj") >= window + horizon).select("idx", "traj", F.explode(F.sequence(F.lit(0), F.size("traj") - window - horizon)).alias("at"))
    last = F.expr(f"traj[at + {window - 1}]")
    rel = lambda p: F.zip_with(F.slice(p, 1, 3), F.slice(last, 1, 3), lambda a, b: a - b)
    x = F.flatten(F.transform(F.expr(f"slice(traj, at + 1, {window})"), rel))
    return flat.select("idx", "at", x.alias("x"), rel(F.expr(f"traj[at + {window + horizon - 1}]")).alias("y"))


def split(n: int, val_fraction: float = 0.2, seed: int = 12345) -> tuple[list[int], list[int]]:
    """Train and validation episodes, the same for every run."""
    order = np.random.default_rng(seed).permutation(n)
    k = max(1, round(n * val_fraction)) if n > 1 else 0
    return sorted(map(int, order[k:])), sorted(map(int, order[:k]))


def order(ordering: str, train: list[int], rank: dict[int, int], seed: int) -> list[int]:
    one_of("ordering", ordering, ORDERINGS)
    if ordering == "shuffled":
        return [int(i) for i in np.random.default_rng(seed).permutation(train)]
    return sorted(train, key=lambda i: (rank[i] if ordering == "curriculum" else -rank[i], i))


def run_arms(data: DataFrame, arms: DataFrame, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """ordering, seed, steps ARRAY<INT>, val_loss ARRAY<DOUBLE>, final_loss, auc: one task trains one arm (ordering, seed, idx, place, is_val) on its windows.

    A network of one hidden layer, by plain gradient steps in NumPy: each task holds the windows of its arm.
    """
    joined = arms.join(data, "idx")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(group["seed"].iloc[0]))
        group = group.sort_values(["place", "at"])
        x, y, val = np.array(group["x"].tolist(), np.float32), np.array(group["y"].tolist(), np.float32), group["is_val"].to_numpy(bool)
        scale = max(float(x[~val].std()), 1e-6)
        x, y = x / scale, y / scale
        w1, b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], cfg.hidden)), np.zeros(cfg.hidden)
        w2, b2 = rng.normal(0, 1 / np.sqrt(cfg.hidden), (cfg.hidden, 3)), np.zeros(3)
        loss = lambda: float(((np.tanh(x[val] @ w1 + b1) @ w2 + b2 - y[val]) ** 2).mean()) if val.any() else 0.0
        steps, curve, step = [0], [loss()], 0
        tx, ty = x[~val], y[~val]
        for _ in range(cfg.epochs):
            for at in range(0, len(tx), cfg.batch):
                bx, by = tx[at : at + cfg.batch], ty[at : at + cfg.batch]
                h = np.tanh(bx @ w1 + b1)
                g = 2 * (h @ w2 + b2 - by) / by.size
                gh = g @ w2.T * (1 - h * h)
                w2 -= cfg.lr * 100 * h.T @ g
                b2 -= cfg.lr * 100 * g.sum(0)
                w1 -= cfg.lr * 100 * bx.T @ gh
                b1 -= cfg.lr * 100 * gh.sum(0)
                step += 1
                if step % cfg.eval_every == 0:
                    steps.append(step)
                    curve.append(loss())
        if steps[-1] != step:
            steps.append(step)
            curve.append(loss())
        area = float(np.trapezoid(curve, steps) / max(steps[-1], 1))
        return pd.DataFrame({"ordering": [group["ordering"].iloc[0]], "seed": [int(group["seed"].iloc[0])], "steps": [steps], "val_loss": [curve], "final_loss": [curve[-1]], "auc": [area]})

    return joined.groupBy("ordering", "seed").applyInPandas(train, "ordering string, seed int, steps array<int>, val_loss array<double>, final_loss double, auc double")


def summarise(runs: DataFrame) -> DataFrame:
    """ordering, n, mean and population deviation of auc and final_loss."""
    return runs.groupBy("ordering").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{k}") for c in ("auc", "final_loss") for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def paired(runs: DataFrame, metric: str, base: str = "shuffled") -> DataFrame:
    """Each other ordering against base, by seed: mean difference, percent, wins (lower) and losses."""
    b = runs.where(F.col("ordering") == base).select("seed", F.col(metric).alias("_b"))
    d = F.col(metric) - F.col("_b")
    return runs.where(F.col("ordering") != base).join(b, "seed").groupBy("ordering").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), (100 * F.avg(d) / F.avg("_b")).alias("pct"), F.count_if(d < 0).alias("wins"), F.count_if(d > 0).alias("losses"))


def paired_p(runs: DataFrame, metric: str, ordering: str, base: str = "shuffled") -> float | None:
    one = lambda o, to: runs.where(F.col("ordering") == o).select("seed", F.col(metric).alias(to))
    return wilcoxon([r["x"] - r["y"] for r in one(ordering, "x").join(one(base, "y"), "seed").orderBy("seed").collect()])  # a row a seed


def judge(pct: float, p: float | None, level: float = 0.05) -> str:
    if p is None or p >= level:
        return "no measurable difference"
    return "better than shuffled" if pct < 0 else "worse than shuffled"


def bands(runs: DataFrame) -> DataFrame:
    """ordering, step, mean, low, high of the validation loss over seeds, as far as the shortest run goes."""
    cut = runs.groupBy("ordering").agg(F.min(F.size("steps")).alias("_n"))
    flat = runs.join(F.broadcast(cut), "ordering").select("ordering", F.posexplode(F.arrays_zip(F.expr("slice(steps, 1, _n)").alias("step"), F.expr("slice(val_loss, 1, _n)").alias("loss"))).alias("pos", "x"))
    return flat.groupBy("ordering", "pos").agg(F.min("x.step").alias("step"), F.avg("x.loss").alias("mean"), F.min("x.loss").alias("low"), F.max("x.loss").alias("high")).drop("pos")
