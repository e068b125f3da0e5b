"""Validated settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass

NORMALIZE = ("none", "center", "zscore")
LINKAGES = ("average", "complete", "single")
SELECTION_METHODS = ("coreset", "random", "stratified", "sequential", "redundant")
SEARCH_METHODS = ("dijkstra", "astar")
TARGET_SELECTIONS = ("hardest", "medoid", "easiest")
SCALINGS = ("rank", "minmax")
ORDERINGS = ("curriculum", "shuffled", "anti")
ARM_MODES = ("auto", "left", "right", "both")
#: Weights of the features that make up difficulty.
DIFFICULTY_WEIGHTS = {"log_tortuosity": 1.0, "log_normalized_jerk": 1.0, "reversal_rate": 0.75, "path_length": 0.5, "workspace_span": 0.35, "duration": 0.25}
UNLABELLED = ("unknown", "", "none", "nan", "null")


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class CleanConfig:
    min_length: int = 30
    arm: str = "auto"
    unit_scale: str | float = "auto"
    max_missing: float = 0.5
    static_std: float = 1e-3
    unit_limit: float = 10.0

    def __post_init__(self):
        one_of("arm", self.arm, ARM_MODES)
        if self.unit_scale != "auto" and not float(self.unit_scale) > 0:
            raise ValueError("unit_scale must be 'auto' or a positive factor")


@dataclass(frozen=True)
class DTWConfig:
    normalize: str = "zscore"
    max_length: int | None = 200
    length_normalize: bool = True
    radius: int | None = None  # Sakoe-Chiba band; 0 and None both mean none
    block: int = 128  # episodes a tile side

    def __post_init__(self):
        one_of("normalize", self.normalize, NORMALIZE)
        if self.max_length is not None and self.max_length < 2:
            raise ValueError("max_length must be at least 2")
        if self.radius is not None and self.radius < 0:
            raise ValueError("radius can't be negative")

    def fingerprint(self) -> dict:
        """What affects the result."""
        return {k: v for k, v in asdict(self).items() if k != "block"}


@dataclass(frozen=True)
class GraphConfig:
    k_neighbors: int = 10
    backslide_tolerance: float = 0.05
    target_step: float = 0.05
    w_difficulty: float = 1.0
    w_interference: float = 1.0
    w_redundancy: float = 1.0
    step_penalty: float = 0.1
    backslide_penalty: float = 2.0
    p_task: float = 0.5
    p_cluster: float = 0.3
    p_embodiment: float = 0.3
    p_source: float = 0.2
    dtw_quantile: float = 0.95
    start_quantile: float = 0.10
    novelty_quantile: float = 0.05

    def __post_init__(self):
        if self.k_neighbors < 1 or self.target_step <= 0:
            raise ValueError("k_neighbors and target_step must be positive")
        for k, v in asdict(self).items():
            if v < 0:
                raise ValueError(f"{k} can't be negative: shortest paths need non-negative weights")
            if k.endswith("quantile") and not 0 <= v <= 1:
                raise ValueError(f"{k} must lie in 0..1")


@dataclass(frozen=True)
class PathConfig:
    search: str = "dijkstra"
    review_every: int = 4
    max_reviews: int = 12

    def __post_init__(self):
        one_of("search", self.search, SEARCH_METHODS)
        if self.review_every < 0 or self.max_reviews < 0:
            raise ValueError("review settings can't be negative")


@dataclass(frozen=True)
class TrainConfig:
    window: int = 16
    horizon: int = 1
    hidden: int = 64
    epochs: int = 3
    lr: float = 1e-3
    batch: int = 256
    val_fraction: float = 0.2
    eval_every: int = 10
