"""From poses to a report, and from a goal to an ordered path: the two plans that the operators make up."""

from __future__ import annotations

import time
from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanConfig, DTWConfig, GraphConfig, PathConfig, one_of
from ..operators import clean, cluster, curriculum, dtw, graph, kinematics, metrics, text
from ..operators import pairs as P
from ..sources import store, zarr

#: Named groups of tasks; a group is used as far as its tasks are present.
DOMAINS = {"garments": ("fold_shirt", "fold_towel", "hang_shirt", "fold_clothes"), "kitchen": ("stir", "pour", "pick_place", "wipe")}


class Report:
    """What Entry A gives: tables, each a DataFrame, and one row of measures."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


class Engine:
    """Plans over raw poses (zarr.POSES without error). Tables that several operators read are written once to the shared folder."""

    def __init__(self, spark: SparkSession, cfg: CleanConfig = CleanConfig(), dtw_cfg: DTWConfig = DTWConfig(), linkage: str = "average", scaling: str = "rank", k: int | None = None):
        self.spark, self.cfg, self.dtw_cfg, self.linkage, self.scaling, self.k = spark, cfg, dtw_cfg, linkage, scaling, k
        self.write, self.seconds, self._memo = store.writer(spark), {}, {}

    def _timed(self, name: str, make):
        began = time.time()
        out = make()
        self.seconds[name] = round(time.time() - began, 3)
        return out

    def load(self, path: str) -> tuple[DataFrame, DataFrame]:
        poses, bad = zarr.split_errors(self.write(zarr.read_poses(self.spark, path)))
        return poses, bad

    def diversity(self, poses: DataFrame, key: str | None = None) -> Report:
        """Entry A. Fewer than two episodes give a report with empty tables. Results are kept by key, the last eight."""
        key = key and store.fingerprint(key, asdict(self.cfg), self.dtw_cfg.fingerprint(), self.linkage, self.scaling, self.k)
        if key in self._memo:
            return self._memo[key]
        frames, episodes, skipped = clean.clean(poses, self.cfg)
        attrs = poses.groupBy("episode_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("fps", "task_name", "task_description", "embodiment")))
        episodes = self._timed("clean", lambda: self.write(episodes.join(attrs, "episode_id", "left").fillna("unknown", ["task_name", "embodiment"]).fillna("", ["task_description"])))
        frames = self.write(frames.join(episodes.select("episode_id", "idx", (1.0 / F.coalesce("fps", F.lit(30.0))).alias("dt")), "episode_id").drop("episode_id"))
        n = episodes.count()
        trajectories = self.write(dtw.episodes(frames, tuple(c for c in frames.columns if c[0] in "xyz" and c != "idx")))
        pairs = self._timed("dtw", lambda: self.write(dtw.pairs(trajectories, self.dtw_cfg)))
        if n < 2:
            out = Report(n=n, episodes=episodes, skipped=skipped, pairs=pairs, trajectories=trajectories, frame=None, curriculum=None, measures=None, ks=None, k=n, agreement=[])
        else:
            tree = self._timed("tree", lambda: cluster.merges(pairs, self.linkage, self.write))
            k, ks = (self.k, None) if self.k else cluster.suggest_k(pairs, n, 2, min(10, n - 1), self.linkage, write=self.write, tree=tree)
            labels = self.write(cluster.agglomerate(pairs, n, max(2, k), self.linkage, self.write, tree))
            scored = self.write(kinematics.difficulty(kinematics.features(frames), scaling=self.scaling))
            meta = episodes.select("idx", "episode_id", "task_name", "task_description", "source", "embodiment")
            table = self.write(curriculum.build(scored, pairs, labels, n, meta))
            place = cluster.project(pairs, n)
            frame = meta.join(labels, "idx").join(place, "idx").join(episodes.select("idx", F.col("n_valid_frames").alias("n_frames"), "arm_used", "missing_frame_ratio"), "idx")
            frame = frame.withColumn("cluster_label", F.concat(F.lit("Group "), F.col("cluster").cast("string"))).join(table.select("idx", "difficulty", "difficulty_z", "stage", "curriculum_rank", "coreset_rank", "is_cluster_medoid"), "idx", "left")
            measures = P.summary(pairs).join(F.broadcast(P.redundancy(pairs))).join(F.broadcast(P.balance(labels))).join(F.broadcast(P.silhouette(pairs, labels)))
            full = labels.join(meta, "idx")
            agreement = [(c, P.adjusted_rand(full, "cluster", c)) for c in ("task_name", "source", "embodiment")]
            out = Report(n=n, episodes=episodes, skipped=skipped, pairs=pairs, trajectories=trajectories, frame=self.write(frame), curriculum=table, stages=curriculum.stage_summary(table), measures=measures, ks=ks, k=max(2, k), agreement=agreement, labels=labels)
        if key:
            while len(self._memo) >= 8:
                self._memo.pop(next(iter(self._memo)))
            self._memo[key] = out
        return out

    def warnings(self, r: Report) -> list[str]:
        """What makes a report doubtful: a heavy tail of distances, or one cluster that holds most episodes."""
        m = r.measures.first()
        share = r.labels.groupBy("cluster").count().agg(F.max("count") / r.n).first()[0]
        return [w for bad, w in ((m["tail_ratio"] and m["tail_ratio"] > 2, "a few pairs are far beyond the rest: distances are dominated by scale"), (share > 0.6, "one cluster holds most episodes")) if bad]

    def compare(self, r: Report, **options) -> tuple[DataFrame, DataFrame]:
        items = r.frame.select("idx", F.col("task_name").alias("task"), "source", "cluster")
        return curriculum.compare(r.pairs, r.labels, r.n, items=items, **options)

    def scoped(self, r: Report, tasks: list[str] | None = None, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and pairs of a scope; difficulty and clusters stay those of the whole set."""
        nodes = r.frame.select("idx", "episode_id", "task_name", F.col("task_name").alias("task"), "task_description", "source", "embodiment", "cluster", "difficulty", "stage", "is_cluster_medoid")
        if domain:
            one_of("domain", domain, tuple(DOMAINS))
            there = {x[0] for x in nodes.select("task").distinct().collect()}
            tasks = [t for t in DOMAINS[domain] if t in there]  # none present: the whole graph
        nodes = clean.in_tasks(nodes, tasks or [])
        return nodes, P.restrict(r.pairs, nodes) if tasks else r.pairs

    def finder(self, r: Report, graph_cfg: GraphConfig = GraphConfig(), tasks: list[str] | None = None, domain: str | None = None) -> PathFinder:
        nodes, pairs = self.scoped(r, tasks, domain)
        return PathFinder(self, self.write(nodes), pairs, graph_cfg)


class PathFinder:
    """Entry B: the clip graph of a scope, and paths through it."""

    def __init__(self, engine: Engine, nodes: DataFrame, pairs: DataFrame, cfg: GraphConfig):
        self.engine, self.spark, self.cfg, self.nodes, self.pairs = engine, engine.spark, cfg, nodes, pairs
        self.norm = engine.write(graph.normalized(pairs, cfg.dtw_quantile))
        self.edges = engine.write(graph.build(pairs, nodes, cfg, engine.write))
        self.docs = engine.write(nodes.select("idx", text.document(*(F.col(c) for c in ("task_name", "task_description", "source", "embodiment"))).alias("doc")))
        self.local = graph.LocalGraph(self.edges)
        rows = nodes.select("idx", "cluster", "difficulty", "is_cluster_medoid").orderBy("idx").limit(cluster.MATRIX_LIMIT + 1).collect()
        if len(rows) > cluster.MATRIX_LIMIT:
            raise ValueError("a path is planned over a bounded scope: choose tasks or a coreset")
        self.cluster = {x["idx"]: x["cluster"] for x in rows}
        self.difficulty = {x["idx"]: 1.0 if x["difficulty"] is None else x["difficulty"] for x in rows}
        self.medoid = {x["idx"] for x in rows if x["is_cluster_medoid"]}

    def distances(self, clips: list[int]) -> dict[tuple[int, int], float]:
        got = self.norm.where(F.col("i").isin(clips) & F.col("j").isin(clips)).select("i", "j", "dn").collect()
        return {(x["i"], x["j"]): x["dn"] for x in got}

    def match(self, goal: str, how: str = "hardest", k: int = 5) -> DataFrame:
        totals = None
        if how == "medoid":
            totals = P.within_sums(self.pairs, self.nodes.select("idx", F.col("task").alias("cluster"))).select("idx", "total")
        return text.match(self.docs, self.nodes.select("idx", "task", "difficulty"), goal, how, k, totals)

    def find(self, goal: str | None = None, target: int | None = None, cfg: PathConfig = PathConfig(), how: str = "hardest") -> dict:
        """The path to a goal's clip (or to a clip): steps, their table, cost and its terms."""
        if target is None:
            target = self.match(goal or "", how).first()["idx"]
        guess = None
        if cfg.search == "astar":
            near = self.norm.where((F.col("i") == target) | (F.col("j") == target)).select((F.col("i") + F.col("j") - target).alias("idx"), "dn").collect()
            guess = {x["idx"]: self.cfg.w_interference * x["dn"] for x in near}
        route, cost = self.local.route(target, cfg.search, guess)
        steps = graph.insert_reviews(route, self.cluster, self.medoid, self.distances(route), cfg)
        return {"target": target, "route": route, "steps": steps, "cost": cost, "terms": graph.cost_terms(route, self.local, self.cfg), "table": graph.path_table(steps, self.norm, self.nodes, self.edges, self.cfg)}

    def report(self, steps: list[tuple[int, bool]]) -> DataFrame:
        one = self.spark.createDataFrame([(0, s, c, r) for s, (c, r) in enumerate(steps)], "k int, step int, idx int, is_review boolean")
        return metrics.report(one, self.nodes, self.norm, ["k"])

    def coreset(self) -> list[int]:
        """The scope's clips in farthest-point order."""
        order = curriculum.coreset_prefix(self.pairs, None, self.engine.write).orderBy("coreset_rank").collect()  # a row a clip of the bounded scope
        return [r["idx"] for r in order] or sorted(self.cluster)

    def compare(self, steps: list[tuple[int, bool]], seeds: int = 50, seed: int = 42, target: int = 0) -> DataFrame:
        """The path's report beside its baselines', means over seeds; one job for all."""
        o = metrics.baselines(self.spark, steps, sorted(self.cluster), self.difficulty, self.coreset(), seeds, seed).withColumn("target", F.lit(target))
        return metrics.mean_reports(metrics.report(o, self.nodes, self.norm, ["target", "ordering", "seed"], "target"), ["target", "ordering"])

    def sweep(self, n_targets: int = 40, seeds: int = 10, seed: int = 0, cfg: PathConfig = PathConfig()) -> DataFrame:
        """Reports of paths and baselines for sampled targets; targets without a path are left out."""
        rng, every = np.random.default_rng(seed), None
        ids, core = sorted(self.cluster), self.coreset()
        for target in rng.choice(ids, min(n_targets, len(ids)), replace=False):
            try:
                route, _ = self.local.route(int(target), cfg.search)
            except ValueError:
                continue
            steps = graph.insert_reviews(route, self.cluster, self.medoid, self.distances(route), cfg)
            o = metrics.baselines(self.spark, steps, ids, self.difficulty, core, seeds, int(target)).withColumn("target", F.lit(int(target)))
            every = o if every is None else every.unionByName(o)
        every = self.engine.write(every)
        return metrics.mean_reports(metrics.report(every, self.nodes, self.norm, ["target", "ordering", "seed"], "target"), ["target", "ordering"])

    def ablation(self, features: DataFrame, n_targets: int = 40, seed: int = 0, keys: tuple[str, ...] = ("difficulty", "duration", "path_length", "tortuosity")) -> DataFrame:
        """Means by sort key of orders of each path's clips by the composite difficulty, by single features, and at random, on measures that difficulty is no part of."""
        rng = np.random.default_rng(seed)
        scope = self.spark.createDataFrame([(c,) for c in self.cluster], "idx int")  # a bounded scope, however many episodes have features
        values = {x["idx"]: x for x in features.join(scope, "idx", "left_semi").select("idx", *keys).collect()}
        rows = []
        for target in rng.choice(sorted(self.cluster), min(n_targets, len(self.cluster)), replace=False):
            try:
                route, _ = self.local.route(int(target))
            except ValueError:
                continue
            orders = {k: sorted(route, key=lambda c: (values[c][k], route.index(c))) for k in keys}
            orders["random"] = [int(c) for c in rng.permutation(route)]
            rows += [(int(target), k, s, c, False) for k, o in orders.items() for s, c in enumerate(o)]
        o = self.spark.createDataFrame(rows, "target int, sort_key string, step int, idx int, is_review boolean")
        r = metrics.report(o, self.nodes, self.norm, ["target", "sort_key"])
        return r.groupBy("sort_key").agg(*(F.avg(c).alias(c) for c in ("task_switch_rate", "cluster_switch_rate", "mean_hop", "near_duplicate_share")))


class Service:
    """The web service's calls as methods; every answer is plain data that strict JSON takes."""

    def __init__(self, spark: SparkSession, poses: DataFrame):
        self.engine, self.poses = Engine(spark), poses
        self._finders: dict = {}

    def health(self) -> dict:
        return {"status": "ok"}

    def _report(self) -> Report:
        return self.engine.diversity(self.poses, "service")

    def _records(self, df: DataFrame, most: int = 5000) -> list[dict]:
        """All rows as plain data; an answer of more than `most` rows is refused, never cut."""
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} rows: ask for a scope of tasks")
        return store.strict(rows)

    def domains(self) -> dict:
        r = self._report()
        tasks = {x["task_name"]: x["count"] for x in r.frame.groupBy("task_name").count().collect()}
        return {"tasks": tasks, "domains": {k: [t for t in v if t in tasks] for k, v in DOMAINS.items()}}

    def run(self) -> dict:
        r = self._report()
        return {"n_episodes": r.n, "k": r.k, "measures": self._records(r.measures)[0], "episodes": self._records(r.frame), "stages": self._records(r.stages), "skipped": self._records(r.skipped), "warnings": self.engine.warnings(r), "agreement": {c: self._records(a)[0] for c, a in r.agreement}, "comparison": self.comparison() if r.n >= 8 else None}

    snapshot = run

    def comparison(self) -> dict:
        scores, null = self.engine.compare(self._report(), methods=("coreset", "random", "stratified", "redundant"))
        return {"subsets": self._records(scores.where("trial = -1")), "null": self._records(null)}

    def _finder(self, overrides: dict | None, tasks: list[str] | None, domain: str | None) -> PathFinder:
        known = asdict(GraphConfig())
        for k in overrides or {}:
            if k not in known:
                raise ValueError(f"unknown graph setting {k}")
        key = store.fingerprint(overrides, tasks, domain)
        if key not in self._finders:
            while len(self._finders) >= 8:
                self._finders.pop(next(iter(self._finders)))
            self._finders[key] = self.engine.finder(self._report(), replace(GraphConfig(), **(overrides or {})), tasks, domain)
        return self._finders[key]

    def graph(self, overrides: dict | None = None, tasks: list[str] | None = None, domain: str | None = None) -> dict:
        f = self._finder(overrides, tasks, domain)
        ids = sorted(f.cluster)
        place = {x["idx"]: [x["UMAP_X"], x["UMAP_Y"]] for x in self._report().frame.where(F.col("idx").isin(ids)).select("idx", "UMAP_X", "UMAP_Y").collect()}
        at = {c: p for p, c in enumerate(ids)}
        links = [(at[a], at[b]) for a, b in f.local.terms if a in at and b in at]
        where = cluster.layout(links, np.array([place[c] for c in ids]))
        return {"nodes": self._records(f.nodes), "edges": self._records(f.edges, 100_000), "layout": store.strict(dict(zip(ids, where)))}

    def path(self, goal: str, overrides: dict | None = None, tasks: list[str] | None = None, domain: str | None = None, seeds: int = 50, **path) -> dict:
        if not isinstance(goal, str) or not goal:
            raise ValueError("a goal needs at least one character")
        if isinstance(seeds, bool) or not isinstance(seeds, int) or seeds < 1:
            raise ValueError("seeds is a number of 1 or more")
        for k in path:
            if k not in asdict(PathConfig()):
                raise ValueError(f"unknown path setting {k}")
        f = self._finder(overrides, tasks, domain)
        found = f.find(goal, cfg=PathConfig(**path))
        return {"goal": goal, "candidates": self._records(f.match(goal)), "target": found["target"], "cost": found["cost"], "terms": found["terms"], "steps": self._records(found["table"].orderBy("step")), "report": self._records(f.report(found["steps"]))[0], "comparison": self._records(f.compare(found["steps"], seeds, target=found["target"]))}

    def redundancy(self, quantile: float = 0.05, most: int = 50) -> list[dict]:
        return self._records(P.redundant_pairs(self._report().pairs, quantile, most))

    def matrix(self) -> DataFrame:
        r = self._report()
        return store.matrix_rows(r.pairs, r.n)

    def previews(self) -> list[dict]:
        """Every episode's way in x and y, centred but not scaled: at most 240 points, or 120 in sets of over 60 episodes."""
        r = self._report()
        points = store.centred(store.decimate(F.col("traj"), 240 if r.n <= 60 else 120))
        xy = r.trajectories.select("idx", F.size("traj").alias("n_frames"), F.transform(points, lambda p: F.slice(p, 1, 2)).alias("points"))
        about = r.episodes.select("idx", "episode_id", "source", "task_name", F.coalesce("fps", F.lit(30.0)).alias("fps"))
        return self._records(about.join(xy, "idx").join(r.curriculum.select("idx", "workspace_span", "path_length"), "idx", "left").orderBy("idx"))

    def trajectory(self, episode_id: str, most: int = 240) -> list:
        r = self._report()
        found = r.trajectories.join(r.episodes.where(F.col("episode_id") == episode_id).select("idx"), "idx").select(store.centred(store.decimate(F.col("traj"), most)).alias("p")).first()
        if found is None:
            raise ValueError(f"no episode {episode_id}")
        return store.strict(found["p"])
