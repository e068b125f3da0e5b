"""Operators on tables against brute force: quantiles by ranges, tiles, clustering, ways for all targets, rehearsal, repair, farthest-point order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.config import GraphConfig, PathConfig
from kinetra.functions import quantiles as Q
from kinetra.functions.stats import erfc, signed_rank, wilcoxon
from kinetra.operators import cluster, curriculum, graph, metrics
from kinetra.operators import pairs as P
from kinetra.sources import store


def pair_table(spark, m):
    rows = [(i, j, float(m[i][j])) for i in range(len(m)) for j in range(i + 1, len(m))]
    return spark.createDataFrame(rows, "i int, j int, d double")


def points(n, dims=3, seed=0, digits=None):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x if digits is None else np.round(x, digits)


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


# ---- quantiles ----


@pytest.mark.parametrize("kind", ["plain", "ties", "skew", "signs"])
def test_quantiles_by_ranges(spark, kind, monkeypatch):
    monkeypatch.setattr(Q, "FETCH", 50)
    monkeypatch.setattr(Q, "BUCKETS", 16)
    rng = np.random.default_rng(3)
    v = {
        "plain": rng.random(4000), "ties": rng.integers(0, 5, 4000).astype(float), "skew": np.r_[np.full(1500, 1.0), 10.0 ** rng.uniform(-300, 300, 1500)],
        "signs": np.r_[-1.7e308, rng.normal(size=2000), 1.7e308],
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double").repartition(4)
    qs = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    assert Q.quantiles(df, "x", qs) == pytest.approx([np.quantile(v, q) for q in qs], rel=1e-12)


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert Q.quantiles(df, "x", [0.0, 0.3, 1.0]) == [3.0] * 3 and Q.quantiles(df.where("false"), "x", [0.5]) == [None]
    g = spark.createDataFrame([(k, float(i)) for k, n in (("a", 9), ("b", 4), (None, 6)) for i in range(n)], "k string, x double")
    for most in (100, 5, 1):
        assert {r.k: r.m for r in Q.grouped_medians(g, ["k"], "x", "m", most).collect()} == {"a": 4.0, "b": 1.5, None: 2.5}


# ---- pairs ----


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_tiles_hold_each_pair_once(spark, blocks):
    x = points(40)
    items = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "idx int, v array<double>")
    m = gaps(x)
    got = {(r.i, r.j): r.d for r in P.euclidean(items, blocks).collect()}
    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    assert all(d == pytest.approx(m[i, j]) for (i, j), d in got.items())
    near = {(r.i, r["rank"]): r.j for r in P.nearest_items(items, 4, blocks).collect()}
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (m[i, j], j))
        assert [near[i, k] for k in (1, 2, 3, 4)] == order[:4]
    assert P.euclidean(items.where("false")).count() == 0 and P.euclidean(items.where("idx = 1")).count() == 0


def test_hops_measured_by_vectors(spark):
    x = points(12, seed=4)
    items = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "idx int, v array<double>")
    norm = graph.normalized(pair_table(spark, np.round(gaps(x), 6)))
    o = spark.createDataFrame([("a", s, s * 5 % 12, False) for s in range(12)] + [("b", 0, 3, False), ("b", 1, 3, True)], "k string, step int, idx int, is_review boolean")
    scale = Q.quantiles(pair_table(spark, np.round(gaps(x), 6)), "d", [0.95])[0]
    nodes = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "idx int, task int, cluster int")
    a = {r.k: r for r in metrics.interference(o, nodes, norm, ["k"]).collect()}
    b = {r.k: r for r in metrics.interference(o, nodes, None, ["k"], lambda h: metrics.with_vectors(h, items, scale)).collect()}
    for k in "ab":
        assert tuple(a[k])[1:] == pytest.approx(tuple(b[k])[1:])


# ---- clusters ----


def slow_merges(m, linkage):
    """One merge at a time: the least (height at 9 decimals, a, b); clusters are told by their least item."""
    own = {i: [i] for i in range(len(m))}
    far = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
    out = []
    while len(own) > 1:
        keys = sorted(own)
        h, a, b = min((round(float(far([m[x][y] for x in own[a] for y in own[b]])), 9), a, b) for at, a in enumerate(keys) for b in keys[at + 1 :])
        out.append((h, a, b))
        own[a] += own.pop(b)
    return out


def slow_labels(n, merges, k):
    own = list(range(n))
    for _, a, b in merges[: n - k]:
        own = [own[a] if c == own[b] else c for c in own]
    first = {c: i for i, c in enumerate(dict.fromkeys(own))}
    return [first[c] for c in own]


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_clustering_on_tables_is_one_merge_at_a_time(spark, linkage):
    write = store.writer(spark)
    x = np.r_[points(7, seed=1), points(5, seed=2) + 4, points(3, seed=3) - 5]
    n, m = len(x), gaps(x)
    want = slow_merges(m, linkage)
    tree = cluster.merges(pair_table(spark, m), linkage, write)
    got = tree.collect()
    assert sorted(r.height for r in got) == pytest.approx(sorted(h for h, _, _ in want))
    if linkage != "single":
        assert {(r.a, r.b) for r in got} == {(a, b) for _, a, b in want}
    items = spark.range(n).select(F.col("id").cast("int").alias("idx"))
    labels = {}
    for r in cluster.labels_at(tree, items, [1, 3, 6, n], write).collect():
        labels.setdefault(r.k, {})[r.idx] = r.cluster
    for k, own in labels.items():
        assert [own[i] for i in range(n)] == slow_labels(n, want, k), k


def test_single_linkage_of_a_chain_and_items_alone(spark):
    write = store.writer(spark)
    x = np.cumsum(1.1 ** np.arange(14))[:, None]
    assert cluster.merges(pair_table(spark, gaps(x)), "single", write).count() == 13
    assert [r.cluster for r in cluster.agglomerate(pair_table(spark, []), 1, 3).collect()] == [0]
    same = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0)], "i int, j int, d double")
    assert {(r.idx, r.cluster) for r in cluster.agglomerate(same, 3, 2).collect()} == {(0, 0), (1, 0), (2, 1)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40) if i % 13] + [(rng.randrange(50, 70), rng.randrange(50, 70)) for _ in range(15)]
    own = {x: x for e in edges for x in e}
    for _ in own:
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    got = cluster.components(spark.createDataFrame([("g", *e) for e in edges], "g string, x int, up int"), store.writer(spark), ("g",)).collect()
    assert {r.x: r.root for r in got} == own


# ---- farthest-point order ----


@pytest.mark.parametrize("batch", [3, 200])
def test_farthest_point_order(spark, batch):
    m = np.round(gaps(points(20, seed=7, digits=1)), 6)  # with ties
    m[4] = m[9]
    m[:, 4] = m[:, 9]
    m[4, 4] = m[4, 9] = m[9, 4] = 0
    order = [min(range(20), key=lambda i: (round(m[i].sum(), 9), i))]
    while len(order) < 20:
        order.append(min((i for i in range(20) if i not in order), key=lambda i: (-min(m[i][j] for j in order), i)))
    got = curriculum.coreset_prefix(pair_table(spark, m), None, store.writer(spark), batch).orderBy("coreset_rank").collect()
    assert [r.idx for r in got] == order


# ---- ways ----


@pytest.fixture(scope="module")
def world(spark):
    n, write = 36, store.writer(spark)
    x = points(n, 2, seed=11)
    rng = random.Random(4)
    nodes = write(spark.createDataFrame([(i, i % 3, i % 4, rng.random(), i % 5 == 0) for i in range(n)], "idx int, cluster int, task int, difficulty double, is_cluster_medoid boolean"))
    norm = write(graph.normalized(pair_table(spark, gaps(x))))
    return nodes, norm, write


def test_ways_for_all_targets(spark, world):
    nodes, norm, write = world
    edges = write(graph.build(norm.select("i", "j", "d"), nodes, GraphConfig(k_neighbors=4), write))
    tree = write(graph.predecessors(edges, graph.shortest(edges, write)))
    ways: dict[int, list] = {}
    for r in graph.routes(tree, write).orderBy("target", "step").collect():
        ways.setdefault(r.target, []).append((r.idx, r.cost))
    local, step = graph.LocalGraph(edges), {(r.src, r.dst): r.weight for r in edges.collect()}
    assert set(ways) == {r.idx for r in nodes.collect()}
    for target, way in ways.items():
        clips = [graph.START, *(c for c, _ in way)]
        cost = local.route(target)[1]
        assert clips[-1] == target and sum(step[e] for e in zip(clips, clips[1:])) == pytest.approx(cost) == way[-1][1]
    some = graph.routes(tree, write, spark.createDataFrame([(3,), (3,), (999,)], "idx int")).collect()
    assert sorted((r.step, r.idx) for r in some) == [(s + 1, c) for s, (c, _) in enumerate(ways[3])]


@pytest.mark.parametrize("every, most", [(1, 5), (2, 3), (3, 99), (0, 3)])
def test_rehearsal_of_all_ways(spark, world, every, most):
    nodes, norm, _ = world
    own = {r.idx: r.cluster for r in nodes.collect()}
    medoid = {r.idx for r in nodes.collect() if r.is_cluster_medoid}
    dn = {(r.i, r.j): r.dn for r in norm.collect()}
    rng, cfg = random.Random(every * 100 + most), PathConfig(review_every=every, max_reviews=most)
    ways = {t: rng.sample(range(36), rng.randint(1, 20)) for t in range(12)}
    table = spark.createDataFrame([(t, s + 1, c) for t, w in ways.items() for s, c in enumerate(w)], "target int, step int, idx int")
    got: dict[int, list] = {}
    for r in graph.rehearsed(table, nodes, norm, cfg).orderBy("target", "step").collect():
        got.setdefault(r.target, []).append((r.idx, r.is_review))
    for t, w in ways.items():
        assert got[t] == graph.insert_reviews(w, own, medoid, dn, cfg), t


def test_repair_takes_the_nearest_allowed_pair(spark, world):
    nodes, norm, write = world
    cfg = GraphConfig(k_neighbors=3)
    dif, dn = {r.idx: r.difficulty for r in nodes.collect()}, {(r.i, r.j): r.dn for r in norm.collect()}
    edges = write(graph.candidate_edges(norm, nodes, cfg).where("NOT cluster_switch"))
    out, start = [(r.src, r.dst) for r in edges.collect()], [min(i for i in dif if i % 3 == 0)]
    links, starts, added = set(out), list(start), set()
    while True:
        seen, front = set(starts), list(starts)
        while front:
            front = [d for s, d in links if s in front and d not in seen]
            seen |= set(front)
        missing = set(dif) - seen
        if not missing:
            break
        best = min(((dn[min(s, t), max(s, t)], t, s) for t in missing for s in seen if dif[s] <= dif[t] + cfg.backslide_tolerance), default=None)
        if best:
            links.add((best[2], best[1]))
            added.add((best[2], best[1]))
        else:
            one = min(missing, key=lambda c: (dif[c], c))
            starts.append(one)
            added.add((graph.START, one))
    got = graph.repair(norm, nodes, edges, spark.createDataFrame([(c,) for c in start], "idx int"), cfg, write).collect()
    assert {(r.src, r.dst) for r in got if r.is_repair} == added and len(added) >= 2
    assert {(r.src, r.dst) for r in got if not r.is_repair} == set(out) | {(graph.START, c) for c in start}


# ---- signed ranks ----


def test_signed_rank_of_groups(spark):
    import math

    rng = random.Random(8)
    groups = {
        "plain": [rng.gauss(0.3, 1) for _ in range(12)], "fifty": [rng.gauss(0, 1) for _ in range(50)], "many": [rng.gauss(0.1, 1) for _ in range(300)], "ties": [rng.choice([-2.0, -1.0, 1.0, 2.0]) for _ in range(30)],
        "zeros": [0.0] * 5 + [rng.gauss(1, 1) for _ in range(9)], "none": [0.0, 0.0], "one": [1.5], "far": [1.0 + i / 100 for i in range(90)],
    }
    rows = [(k, 10.0 + x, 10.0) for k, v in groups.items() for x in (round(x, 3) for x in v)] + [("plain", None, 1.0), ("lost", None, 2.0)]
    got = {r.k: r for r in signed_rank(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == set(groups)
    for k, r in got.items():
        d = [(10.0 + round(x, 3)) - 10.0 for x in groups[k]]
        p = wilcoxon(d)
        assert (r.n, r.a_lower, r.ties, r.a_higher) == (len(d), sum(x < 0 for x in d), d.count(0.0), sum(x > 0 for x in d))
        assert r.p_value == (None if p is None else pytest.approx(p, abs=1e-9)), k
    x = spark.createDataFrame([(i / 7,) for i in range(60)], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-6, abs=1e-12) for r in x)
