"""Queries that do their whole job: what earlier forms left out, and distances that are reduced where they are computed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.config import GraphConfig
from kinetra.operators import clean, curriculum, graph, metrics, tiles
from kinetra.operators import pairs as P
from kinetra.sources import store, tables


def test_first_seen_counts_appearances(spark):
    steps = spark.createDataFrame([("a", 3), ("b", 2), ("a", 1), ("a", 3)], "k string, at int")
    assert [tuple(r) for r in store.first_seen(steps, "k", "at").collect()] == [("a", 1, 3), ("b", 2, 1)]


# ---- distances that are reduced in tiles ----


def cloud(n, seed=0):
    """Points of which some are copies, some nearly so, and some far from the origin."""
    x = np.random.default_rng(seed).normal(size=(n, 5))
    x[n // 4 : n // 3] = x[0]
    x[n // 3 : n // 2] = x[: n // 2 - n // 3] + 1e-7
    return x


def table(spark, x):
    rows = [(i, list(map(float, v)), i % 3, "ab"[i % 2], i % 5, i % 4) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "idx int, v array<double>, cluster int, k string, task int, source int")


@pytest.fixture(scope="module")
def world(spark):
    x = cloud(90)
    m = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    pairs = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(90) for j in range(i + 1, 90)], "i int, j int, d double")
    return table(spark, x).cache(), pairs.cache(), m


@pytest.fixture(params=[1000, 13])
def side(request, monkeypatch):
    monkeypatch.setattr(tiles, "CHUNK", 16 if request.param == 13 else 512)
    real = tiles.dealt
    monkeypatch.setattr(tiles, "dealt", lambda items, keys=(), extra=(), side=None: real(items, keys, extra, side or request.param))


def rows(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_tiles_reduce_as_pairs_do(spark, world, side):
    items, pairs, _ = world
    lab = items.select("idx", "cluster")
    assert rows(tiles.euclidean(items)) == rows(pairs)
    assert rows(tiles.nearest(items)) == rows(P.nearest(pairs))
    assert rows(P.summary_of(items)) == rows(P.summary(pairs)) and rows(P.redundancy_of(items)) == rows(P.redundancy(pairs))
    assert rows(P.within_sums_of(items)) == rows(P.within_sums(pairs, lab)) and rows(P.medoids_of(items)) == rows(P.medoids(pairs, lab))
    assert rows(P.global_medoid_of(items)) == rows(P.global_medoid(pairs)) and rows(P.silhouette_of(items)) == rows(P.silhouette(pairs, lab))
    for k in (1, 4, 30, 200):
        assert rows(tiles.knn(items, k)) == rows(P.knn(pairs, k))
    assert rows(P.redundant_pairs_of(items, 0.05, 50)) == rows(P.redundant_pairs(pairs, 0.05, 50))
    got, want = (f.select("k", "n", "diversity_score", "median_pairwise", "min_pairwise", "mean_nn_distance", "redundancy_ratio", "n_tasks_covered") for f in (P.score_subsets_of(items.select("k", "idx"), ["k"], items), P.score_subsets(pairs, items.select("k", "idx"), ["k"], items)))
    assert rows(got) == rows(want)


def test_quantiles_of_tiles(spark, world, side, monkeypatch):
    items, _, m = world
    d = m[np.triu_indices(90, 1)]
    qs = [0.0, 0.05, 0.3, 0.95, 1.0]
    for counted in (4096, 16):
        monkeypatch.setattr(tiles, "COUNTED", counted)
        assert tiles.quantiles(items, qs)[()] == pytest.approx([np.quantile(d, q) for q in qs], abs=1e-12)


def test_edges_of_vectors(spark, world):
    items, pairs, _ = world
    cfg = GraphConfig(k_neighbors=5)
    nodes = items.withColumns({"difficulty": F.col("idx") / 90.0, "embodiment": F.col("idx") % 2})
    norm = graph.normalized(pairs, cfg.dtw_quantile)
    scale, floor = graph.scale_of(nodes)
    assert floor == pytest.approx(graph.novelty_floor(norm).first()[0], abs=1e-12)
    assert rows(graph.candidate_edges_of(nodes, cfg)) == rows(graph.candidate_edges(norm, nodes, cfg))


def test_tiles_of_little(spark):
    none, one = table(spark, cloud(12)).where("false"), table(spark, cloud(12)).where("idx = 1")
    for items in (none, one):
        for f in (tiles.nearest(items), tiles.knn(items), tiles.sums(items), tiles.euclidean(items), tiles.closest(items)):
            assert f.count() == 0
        assert tiles.quantile(items, 0.5) is None and P.summary_of(items).first().n_pairs == 0


# ---- poses ----


def test_poses_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "POSES_A_TASK", 300)
    poses = tables.lineitem_poses(spark, "/root/testdata/sf0.001")
    assert poses.rdd.getNumPartitions() == -(-poses.count() // 300)
    plan = clean.arm_quality(poses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # windows and sums stay where the rows were dealt to


# ---- the clip graph and orders ----


@pytest.mark.parametrize("batch", [7, 500])
def test_farthest_point_order_of_vectors(spark, world, batch):
    items, pairs, _ = world
    write = store.writer(spark)
    want = rows(curriculum.coreset_prefix(pairs, None, write))
    assert rows(curriculum.coreset_prefix_of(items, None, write, batch)) == want
    assert rows(curriculum.coreset_prefix_of(items, 9, write, batch)) == [r for r in want if r[1] <= 9]
    assert rows(curriculum.coreset_prefix_of(items.where("idx = 1"), None, write)) == rows(curriculum.coreset_prefix(pairs.where("false"), None, write)) == []


def test_repair_and_redundancy_of_vectors(spark, world, monkeypatch):
    monkeypatch.setattr(tiles, "CHUNK", 16)
    items, pairs, _ = world
    write, cfg = store.writer(spark), GraphConfig(k_neighbors=60)
    nodes = write(items.withColumns({"difficulty": F.col("idx") / 90.0, "embodiment": F.col("idx") % 2}))
    norm = write(graph.normalized(pairs, cfg.dtw_quantile))
    edges = write(graph.candidate_edges(norm, nodes, cfg).where("NOT embodiment_switch"))
    start = nodes.where("idx = 0").select("idx")
    got, want = (f.select("src", "dst", "is_repair", "weight") for f in (graph.repair_of(nodes, edges, start, cfg, write, graph.scale_of(nodes)), graph.repair(norm, nodes, edges, start, cfg, write)))
    assert rows(got) == rows(want) and got.where("is_repair").count()
    missing, seen = nodes.where("idx % 3 = 0"), nodes.where("idx % 3 = 1")
    few, one = (tiles.best_sources(seen, missing, 0.05, 2.0, side=s).groupBy("dst").agg(F.min(F.struct("dn", "src")).alias("x")) for s in (11, 1000))
    assert rows(few) == rows(one)
    order = nodes.select(F.col("source").alias("k"), (F.col("idx") + 1).alias("step"), "idx", F.lit(False).alias("is_review"))
    assert rows(metrics.path_redundancy_of(order, nodes, ["k"])) == rows(metrics.path_redundancy(order, norm, ["k"]))
