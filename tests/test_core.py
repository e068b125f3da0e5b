"""Ground truth, invariants and planted structure for the episode operators."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetra.config import CleanConfig, DTWConfig, GraphConfig, PathConfig
from kinetra.functions import ranks
from kinetra.functions.stats import average_ranks, wilcoxon
from kinetra.operators import clean, cluster, curriculum, dtw, graph, kinematics, metrics, text, training
from kinetra.operators import pairs as P
from kinetra.plans.engine import Engine, Service
from kinetra.sources import store, zarr


def frames(spark, episodes, dt=1 / 30):
    rows = [(i, k, *map(float, p), dt) for i, e in enumerate(episodes) for k, p in enumerate(e)]
    return spark.createDataFrame(rows, "idx int, frame int, x double, y double, z double, dt double")


def pair_table(spark, m):
    n = len(m)
    return spark.createDataFrame([(i, j, float(m[i][j])) for i in range(n) for j in range(i + 1, n)], "i int, j int, d double")


def planted(sizes=(6, 6, 6), spread=0.2, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.permutation(np.eye(6) * 10)[: len(sizes)]
    pts = np.vstack([c + rng.normal(0, spread, (k, 6)) for c, k in zip(centres, sizes)])
    return np.linalg.norm(pts[:, None] - pts[None], axis=-1), np.repeat(range(len(sizes)), sizes)


# ---- kinematics and difficulty ----


def test_known_motions(spark):
    t = np.linspace(0, 1, 100)
    line = np.column_stack([t, 0 * t, 0 * t])
    zigzag = np.column_stack([np.arange(100) % 2, 0 * t, 0 * t])
    circle = np.column_stack([np.cos(2 * np.pi * np.linspace(0, 1, 200)), np.sin(2 * np.pi * np.linspace(0, 1, 200)), np.zeros(200)])
    wave = np.column_stack([np.sin(6 * t), t, t * t])
    got = {r.idx: r for r in kinematics.features(frames(spark, [line, zigzag, circle, wave, wave * 100, np.zeros((1, 3)), np.zeros((2, 3)), np.zeros((3, 3))])).collect()}
    assert got[0].tortuosity == pytest.approx(1) and got[0].path_length == pytest.approx(1) and got[0].reversal_rate == 0 and got[0].duration == 100
    assert got[1].reversal_rate > 0.5
    assert 10 < got[2].tortuosity < 1e5
    assert got[3].log_normalized_jerk == pytest.approx(got[4].log_normalized_jerk)
    for i in (5, 6, 7):
        assert all(math.isfinite(v) for v in got[i])
    assert got[5].tortuosity == 1 and got[5].path_length == 0
    v = np.diff(wave, axis=0) * 30
    assert got[3].max_speed == pytest.approx(np.linalg.norm(v, axis=1).max())
    assert got[3].rms_jerk == pytest.approx(np.sqrt((np.diff(v, n=2, axis=0) ** 2).sum(1).mean()) * 900)


def test_standing_frames_do_not_hide_reversals(spark):
    x = [0, 1, 1, 0, 0, 1, 2]
    got = kinematics.features(frames(spark, [[(v, 0, 0) for v in x]])).first()
    assert got.reversal_rate == pytest.approx(2 / 3)


def test_scaling(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 1000])], "idx int, path_length double")
    rank = {r.idx: r.difficulty for r in kinematics.difficulty(df).collect()}
    assert [rank[i] for i in range(6)] == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1])
    low = {r.idx: r.difficulty for r in kinematics.difficulty(df, scaling="minmax").collect()}
    assert low[4] < 0.01 and low[5] == 1
    flat = spark.createDataFrame([(i, 2.0) for i in range(4)], "idx int, path_length double")
    assert {r.difficulty for r in kinematics.difficulty(flat).collect()} == {0.0}
    with pytest.raises(ValueError):
        kinematics.difficulty(df, scaling="other")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_average_rank(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx int, v double")
    got = {r.idx: r.r for r in ranks.average_rank(df, "v", "r").collect()}
    assert [got[i] for i in range(len(values))] == average_ranks([float(v) for v in values])


# ---- warping ----


def naive(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return math.sqrt(d[-1, -1])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.lists(st.integers(1, 15), min_size=1, max_size=6))
def test_kernel_is_the_plain_recurrence(seed, n, lengths):
    rng = np.random.default_rng(seed)
    a, others = rng.normal(size=(n, 3)), [rng.normal(size=(k, 3)) for k in lengths]
    assert dtw.one_to_many(a, others) == pytest.approx([naive(a, o) for o in others])
    assert dtw.one_to_many(a, [a])[0] == 0
    assert dtw.one_to_many(others[0], [a])[0] == pytest.approx(dtw.one_to_many(a, [others[0]])[0])
    assert (dtw.one_to_many(a, others, radius=1) >= dtw.one_to_many(a, others) - 1e-12).all()


def test_pairs_and_invariances(spark):
    rng = np.random.default_rng(2)
    base = np.cumsum(rng.normal(size=(40, 3)), axis=0)
    eps = [base, base + [10, -5, 3], base * 10, np.cumsum(rng.normal(size=(55, 3)), axis=0)]
    t = dtw.episodes(frames(spark, eps))
    get = lambda **k: {(r.i, r.j): r.d for r in dtw.pairs(t, DTWConfig(**k, block=2)).collect()}
    z, c, n = get(normalize="zscore"), get(normalize="center"), get(normalize="none", length_normalize=False)
    assert len(z) == 6 and z[0, 1] == pytest.approx(0, abs=1e-6) and z[0, 2] == pytest.approx(0, abs=1e-6)
    assert c[0, 1] == pytest.approx(0, abs=1e-6) and c[0, 2] > 1e-3
    for i, j in n:
        assert n[i, j] == pytest.approx(naive(eps[i], eps[j]))
    sql = t.alias("a").join(t.alias("b"), F.col("a.idx") < F.col("b.idx")).select("a.idx", F.col("b.idx").alias("j"), F.expr(dtw.sql_distance("a.traj", "b.traj")).alias("d"))
    for r in sql.collect():
        assert r.d == pytest.approx(n[r.idx, r.j])
    assert dtw.pairs(t.limit(1)).count() == 0


def test_resampling_keeps_the_ends():
    t = np.column_stack([np.linspace(0, 1, 321) ** 2] * 3)
    r = dtw.resample(t, 50)
    assert len(r) == 50 and (r[0] == t[0]).all() and (r[-1] == t[-1]).all()
    with pytest.raises(ValueError):
        DTWConfig(normalize="odd")


# ---- cleaning and stores ----


def test_stores(spark, tmp_path):
    zarr.synthetic_set(str(tmp_path / "set"), 5, broken=True)
    poses, bad = zarr.split_errors(zarr.read_poses(spark, str(tmp_path / "set")))
    (tmp_path / "set" / "broken.zarr").mkdir()
    (tmp_path / "set" / "broken.zarr" / "zarr.json").write_text("{")
    poses2, bad2 = zarr.split_errors(zarr.read_poses(spark, str(tmp_path / "set")))
    assert bad.count() == 0 and [r.episode_id for r in bad2.collect()] == ["broken"]
    f, episodes, skipped = clean.clean(poses)
    e, s = {r.episode_id: r for r in episodes.collect()}, {r.episode_id: r.reason for r in skipped.collect()}
    assert set(s) == {"synth__edge_dead__0000", "synth__edge_mostly_missing__0000"} and "100% of frames" in s["synth__edge_dead__0000"]
    assert e["synth__edge_millimetres__0000"].unit_scale == 1e-3 and e["synth__edge_dropout__0000"].missing_frame_ratio == pytest.approx(0.3)
    assert [r.idx for r in episodes.orderBy("episode_id").collect()] == list(range(len(e))) and {r.source for r in e.values()} == {"synth"}
    zero = f.where("x = 0 AND y = 0 AND z = 0").count()
    assert zero == 0
    assert f.where("episode_id = 'synth__edge_dropout__0000'").count() == 210
    assert {r.kind: r.n for r in clean.rejection_kinds(skipped).collect()} == {"sentinel": 2}
    assert zarr.read_poses(spark, str(tmp_path / "nowhere")).count() == 0


def test_stores_are_found_by_listing(tmp_path):
    pose = {"left.obs_ee_pose": np.ones((5, 7))}
    for at in ("e0.zarr", "lab/e1.zarr", "lab/day/e1.zarr", "lab/day/e2.zarr", "site/a/e3.zarr", "site/a/b/e4.zarr", "lab/e5.zarr/inner.zarr"):
        zarr.write_store(str(tmp_path / at), pose, {})
    ids = lambda **k: {s.episode_id: s.source for s in zarr.discover(str(tmp_path), **k)}
    assert ids() == {"e0": "", "lab__e1": "lab", "lab__day__e1": "lab", "e2": "lab", "e5": "lab", "e3": "site"}  # nothing within a store, nothing four levels down
    assert ids(depth=4)["e4"] == "site" and ids(depth=1) == {"e0": ""}
    assert ids(per_source=1) == {"e0": "", "e1": "lab", "e3": "site"}
    assert zarr.discover(str(tmp_path / "nowhere")) == []
    assert [s.episode_id for s in zarr.discover(str(tmp_path / "e0.zarr") + "/")] == ["e0"]
    zarr.write_store(str(tmp_path / "plain"), pose, {})
    assert [s.episode_id for s in zarr.discover(str(tmp_path / "plain"))] == ["plain"]


def test_only_chosen_arrays_are_opened(tmp_path, monkeypatch):
    zarr.write_store(str(tmp_path / "e.zarr"), {k: np.ones((250, 7)) for k in ("left.obs_ee_pose", "right.obs_ee_pose", "obs_head_pose", "images")}, {"fps": 10})
    opened, read = [], zarr._bytes
    monkeypatch.setattr(zarr, "_bytes", lambda f, p: opened.append(p.split("e.zarr/")[1]) or read(f, p))
    reader = zarr.StoreReader({"path": str(tmp_path), "keys": "left.obs_ee_pose,obs_head_pose"})
    parts = reader.partitions()
    assert not opened and len(parts) == 1
    rows = [r for b in reader.read(parts[0]) for r in b.to_pylist()]
    assert opened == ["zarr.json", "left.obs_ee_pose/zarr.json", *(f"left.obs_ee_pose/c/{i}/0" for i in range(3))]
    assert len(rows) == 300 and {r["fps"] for r in rows} == {10.0} and rows[250]["x"] == 0.0  # padded to whole chunks


def test_reading_and_fetching_stores(spark, tmp_path):
    root, rng = tmp_path / "set", np.random.default_rng(1)
    poses = {at: rng.normal(size=(30 + i, 7)) for i, at in enumerate(("x/e1", "y/e1", "y/e2"))}
    for at, p in poses.items():
        zarr.write_store(str(root / f"{at}.zarr"), {"obs_ee_pose": p, "images": p}, {"task_name": at})
    zarr.write_store(str(root / "y/odd.zarr"), {"obs_ee_pose": np.ones((5, 3))}, {"total_frames": "many"})
    got = zarr.read_poses(spark, str(root)).where("error IS NULL AND frame < total_frames").toPandas()
    for name, at in (("x__e1", "x/e1"), ("y__e1", "y/e1"), ("e2", "y/e2")):
        one = got[got.episode_id == name].sort_values("frame")
        assert np.array_equal(one[["x", "y", "z"]].to_numpy(), poses[at][:, :3]) and set(one.task_name) == {at}
    assert zarr.read_poses(spark, str(root)).where("error IS NOT NULL").first().error.startswith("unreadable store")
    assert zarr.read_poses(spark, str(root / "y/e2.zarr")).where("frame = 0").count() == 1
    listed = zarr.stores(spark, str(root))
    assert {r.episode_id for r in store.balanced_take(listed, "source", "path", 2).collect()} == {"x__e1", "y__e1"}
    (root / "y/e2.zarr/obs_ee_pose/zarr.json").write_text("{")
    done = {r.episode_id: r for r in zarr.fetch(listed, str(root), str(tmp_path / "copy"), extras=("images",)).collect()}
    assert done["x__e1"].files == 5 and done["x__e1"].error is None and done["e2"].error
    assert sum(f.stat().st_size for f in (tmp_path / "copy/x__e1.zarr").rglob("*") if f.is_file()) == done["x__e1"].bytes
    again = zarr.read_poses(spark, str(tmp_path / "copy")).where("episode_id = 'y__e1' AND frame < total_frames").orderBy("frame").toPandas()
    assert np.array_equal(again[["x", "y", "z"]].to_numpy(), poses["y/e1"][:, :3])


def test_arms(spark):
    rng = np.random.default_rng(4)
    quiet, lively = np.ones((60, 3)) + rng.normal(0, 0.002, (60, 3)), np.cumsum(rng.normal(0, 0.1, (80, 3)), axis=0)
    rows = [("a__1", arm, k, *map(float, p), n) for arm, e, n in (("left", quiet, 60), ("right", lively, 70)) for k, p in enumerate(e)] + [("b", "left", k, 0.5, 0.5, 0.5, 0) for k in range(100)] + [("c", "left", k, float(k), 0.0, 1.0, 20) for k in range(50)]
    poses = spark.createDataFrame(rows, "episode_id string, arm string, frame int, x double, y double, z double, total_frames int")
    _, e, s = clean.clean(poses)
    assert {r.episode_id: r.arm_used for r in e.collect()} == {"a__1": "right"}
    assert {r.episode_id: r.reason for r in s.collect()} == {"b": "left: static arm", "c": "left: only 20 valid frames"}
    f, e, _ = clean.clean(poses, CleanConfig(arm="both"))
    assert f.columns[-3:] == ["x2", "y2", "z2"] and f.count() == 60
    assert {r.arm_used for r in clean.clean(poses, CleanConfig(arm="left"))[1].collect()} == {"left"}
    with pytest.raises(ValueError):
        CleanConfig(arm="middle")


def test_store_helpers(spark, tmp_path):
    df = spark.createDataFrame([("p/x/e1", 1.0), ("p/y/e2", float("nan"))], "path string, v double")
    names = [r[0] for r in df.select(store.flat_name(F.col("path"), "p/")).collect()]
    assert names == ["x__e1", "y__e2"]
    assert [r[0] for r in df.select(store.path_of(store.flat_name(F.col("path"), "p/"), "p/")).collect()] == ["p/x/e1.zarr", "p/y/e2.zarr"]
    assert [r.v for r in store.finite(df).collect()] == [1.0, None]
    assert json.loads(store.to_json({"a": float("nan"), 1: np.float32(2), "b": np.array([1.5, np.inf])})) == {"a": None, "1": 2.0, "b": [1.5, None]}
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert store.cached(spark, str(tmp_path), "k", make).count() == 2
    assert len(calls) == 1 and store.content_fingerprint(df) == store.content_fingerprint(df.orderBy("path"))
    arr = spark.range(1).select(F.sequence(F.lit(0), F.lit(99)).alias("a"))
    got = arr.select(store.decimate(F.col("a"), 7)).first()[0]
    assert got == [int(np.rint(k * 99 / 6)) for k in range(7)] and arr.select(store.decimate(F.col("a"), 200)).first()[0] == list(range(100))
    g = spark.createDataFrame([(s, i) for s in "ab" for i in range(3)] + [("c", 0)], "s string, i int")
    assert [(r.s, r.i) for r in store.balanced_take(g, "s", "i", 4).collect()] == [("a", 0), ("b", 0), ("c", 0), ("a", 1)]
    m = np.array([[0, 1, 2], [1, 0, 3], [2, 3, 0]], "<f4")
    assert b"".join(bytes(r.row) for r in store.matrix_rows(pair_table(spark, m), 3).orderBy("i").collect()) == m.tobytes()


# ---- pairs, clusters, subsets ----


def test_planted_groups(spark):
    m, truth = planted()
    p, n = pair_table(spark, m), len(m)
    k, table = cluster.suggest_k(p, n)
    assert k == 3 and table.count() == 9
    for linkage in ("average", "complete", "single"):
        labels = cluster.agglomerate(p, n, 3, linkage)
        got = [r.cluster for r in labels.orderBy("idx").collect()]
        assert len(set(zip(got, truth))) == 3 and got[0] == 0
    full = labels.join(spark.createDataFrame(list(enumerate(map(str, truth))), "idx int, t string"), "idx")
    assert P.adjusted_rand(full, "cluster", "t").first().ari == pytest.approx(1)
    assert P.silhouette(p, labels).first().silhouette > 0.8 and P.balance(labels).first().cluster_balance == pytest.approx(1)
    med = {r.cluster: r.idx for r in P.medoids(p, labels).collect()}
    for c, i in med.items():
        own = [x for x in range(n) if got[x] == c]
        assert i == min(own, key=lambda x: (round(m[x][own].sum(), 9), x))
    xyz = cluster.project(p, n)
    assert xyz.count() == n and cluster.project(p.where("false"), 2).count() == 2
    with pytest.raises(ValueError):
        cluster.agglomerate(p, n, 3, "ward")
    with pytest.raises(ValueError):
        cluster.matrix(p, cluster.MATRIX_LIMIT + 1)


def test_summary_is_numpy(spark):
    m, _ = planted((5, 4), 2.0)
    v = m[np.triu_indices(9, 1)]
    s = P.summary(pair_table(spark, m)).first()
    assert (s.n_pairs, s.diversity_score, s.median_pairwise, s.std_pairwise, s.tail_ratio) == pytest.approx((36, v.mean(), np.median(v), v.std(), np.quantile(v, 0.99) / np.median(v)))
    nn = np.where(np.eye(9, dtype=bool), np.inf, m).min(1)
    r = P.redundancy(pair_table(spark, m)).first()
    assert (r.mean_nn_distance, r.redundancy_ratio) == pytest.approx((nn.mean(), (nn <= np.quantile(v, 0.05)).mean()))
    assert P.summary(pair_table(spark, [])).first().tail_ratio is None


def test_coreset(spark):
    x = np.array([0, 0.1, 0.2, 50, 100])
    m = np.abs(x[:, None] - x)
    order = [r.idx for r in curriculum.coreset_order(pair_table(spark, m), 5).orderBy("coreset_rank").collect()]
    assert set(order[:3]) >= {3, 4} or set(order[:3]) >= {0, 4} and sorted(order) == list(range(5))
    few = [r.idx for r in curriculum.coreset_prefix(pair_table(spark, m), 3, store.writer(spark)).orderBy("coreset_rank").collect()]
    assert few == order[:3]


def test_subsets(spark):
    m, truth = planted((40, 15, 8, 5, 4, 3), 0.01)
    p, n = pair_table(spark, m), len(m)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "idx int, cluster int")
    items = labels.withColumns({"task": F.col("cluster"), "source": F.lit(0)})
    scores, null = curriculum.compare(p, labels, n, ("coreset", "stratified", "sequential", "redundant", "random"), 12, trials=40, items=items)
    s = {r.method: r for r in scores.where("trial = -1").collect()}
    assert all(r.n == 12 for r in s.values()) and s["coreset"].n_clusters_covered == 6 and s["stratified"].n_clusters_covered == 6 and s["sequential"].n_clusters_covered == 1
    z = {r.method: r for r in null.collect()}
    assert z["coreset"].z > 1 and z["coreset"].percentile == 100 and z["sequential"].percentile == 0
    d = {r.metric: r.better for r in P.deltas(scores.where("method = 'coreset'"), scores.where("method = 'sequential'"), ["diversity_score", "redundancy_ratio"]).collect()}
    assert d["diversity_score"] == "a"
    assert curriculum.budget_curve(p, labels, n, ("coreset", "sequential"), (5, 10, 500)).count() == 4
    with pytest.raises(ValueError):
        curriculum.select("best", 3, p, labels, n)


# ---- graph and paths ----


@pytest.fixture(scope="module")
def clip_graph(spark):
    m, truth = planted((10, 8, 6), 1.0, 5)
    n, rng = len(m), np.random.default_rng(6)
    nodes = spark.createDataFrame([(i, f"t{truth[i]}", int(truth[i]), float(d), f"s{i % 2}", "e") for i, d in enumerate(rng.permutation(n) / (n - 1))], "idx int, task string, cluster int, difficulty double, source string, embodiment string")
    write = store.writer(spark)
    p = pair_table(spark, m)
    return p, nodes, write(graph.build(p, nodes, GraphConfig(k_neighbors=3), write)), write


def test_graph_invariants(spark, clip_graph):
    p, nodes, edges, write = clip_graph
    cfg = GraphConfig(k_neighbors=3)
    rows = edges.collect()
    assert all(r.weight >= 0 for r in rows) and all(r.difficulty_delta >= -cfg.backslide_tolerance for r in rows)
    starts = spark.createDataFrame([(graph.START,)], "idx int")
    assert graph.reachable(edges, starts, write).count() == nodes.count() + 1
    local = graph.LocalGraph(edges)
    cost = {r.idx: r.cost for r in graph.shortest(edges, write).collect()}
    for target in range(0, 24, 5):
        route, c = local.route(target)
        assert route[-1] == target and c == pytest.approx(cost[target], abs=1e-6)
        assert sum(graph.cost_terms(route, local, cfg).values()) == pytest.approx(c)
    with pytest.raises(ValueError):
        local.route(99)
    with pytest.raises(ValueError):
        GraphConfig(w_difficulty=-1)
    with pytest.raises(ValueError):
        graph.build(p, nodes.limit(1), cfg, write)


def test_reviews():
    route, own = list(range(9)), {i: i // 3 for i in range(9)}
    steps = graph.insert_reviews(route, own, {0}, {}, PathConfig(review_every=2, max_reviews=3))
    assert [c for c, r in steps if not r] == route and sum(r for _, r in steps) == 3 and not steps[-1][1]
    assert graph.insert_reviews(route, own, set(), {}, PathConfig(review_every=0)) == [(c, False) for c in route]
    seen = []
    for c, r in steps:
        assert not r or c in seen
        seen.append(c)


def test_path_table_and_report(spark, clip_graph):
    p, nodes, edges, write = clip_graph
    norm = graph.normalized(p)
    local = graph.LocalGraph(edges)
    route, _ = max((local.route(t) for t in range(24)), key=lambda x: len(x[0]))
    steps = [(c, False) for c in route] + [(route[0], True)]
    t = graph.path_table(steps, norm, nodes, edges, GraphConfig(k_neighbors=3)).orderBy("step").collect()
    assert t[0].edge_weight is None and t[-1].edge_weight is None and t[-1].reviews_step == 1
    assert all(r.on_graph_edge for r in t[1:-1])
    o = metrics.baselines(spark, steps, list(range(24)), {r.idx: r.difficulty for r in nodes.collect()}, list(range(24)), 3)
    rep = metrics.mean_reports(metrics.report(o, nodes, norm, ["ordering", "seed"]), ["ordering"])
    got = {r.ordering: r for r in rep.collect()}
    assert set(got) == {"path", "random_order", "random_subset", "difficulty_sorted", "coreset_prefix"} if len(route) > 1 else {"path"}
    assert got["difficulty_sorted"].spearman == pytest.approx(1) and got["path"].spearman_with_reviews is not None and got["random_order"].spearman_with_reviews is None


def test_ordering_measures(spark):
    nodes = spark.createDataFrame([(i, i % 2, i % 2, d, 0, 0) for i, d in enumerate([0.1, 0.2, 0.9, 0.3])], "idx int, task int, cluster int, difficulty double, source int, embodiment int")
    o = spark.createDataFrame([("up", s, c, False) for s, c in enumerate([0, 1, 3, 2])] + [("rep", s, c, False) for s, c in enumerate([0, 1, 0, 1])] + [("one", 0, 2, False)], "k string, step int, idx int, is_review boolean")
    mono = {r.k: r for r in metrics.monotonicity(o, nodes, ["k"]).collect()}
    assert mono["up"].spearman == pytest.approx(1) and mono["up"].n_large_jumps == 1 and mono["up"].max_jump == pytest.approx(0.6) and mono["one"].spearman == 0
    norm = graph.normalized(pair_table(spark, np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0)))))
    red = {r.k: r for r in metrics.path_redundancy(o, norm, ["k"]).collect()}
    assert red["rep"].distinct_ratio == 0.5
    assert {(r.k, r.step): r.seen for r in metrics.coverage_curve(o, nodes, ["k"]).collect()}["rep", 3] == 2
    sweep = spark.createDataFrame([(t, o_, float(v)) for t in range(3) for o_, v in (("a", 1), ("b", 1 + t))], "target int, ordering string, m double")
    v = metrics.verdict(sweep, "m", "a", "b")
    assert (v["a_better"], v["ties"], v["b_better"]) == (2, 1, 0)


def test_wilcoxon_known_values():
    assert wilcoxon(list(range(1, 9))) == pytest.approx(0.0078125)
    assert wilcoxon([-1, -2, 3, 4, 5, 6, 7, 8]) == pytest.approx(0.0390625)
    assert wilcoxon([1.0, 2.0, 3.0] + [0.0] * 37) == pytest.approx(0.10880943, abs=1e-8)
    assert wilcoxon([1.0, 1.0, 3.0] + [0.0] * 37) == pytest.approx(0.10247043, abs=1e-8)
    assert wilcoxon([0.0, 0.0]) is None


# ---- goals and training ----


def test_goal_match(spark):
    rows = [(0, "stirPot", "stir the pot with a spoon", 0.2), (1, "stirPot", "stir the soup", 0.9), (2, "wipe_table", "wipe the table clean", 0.5), (3, "", "", None)]
    df = spark.createDataFrame(rows, "idx int, task string, description string, difficulty double")
    docs = df.select("idx", text.document(F.col("task"), F.col("description")).alias("doc"))
    assert docs.orderBy("idx").first().doc == "stir pot stir the pot with a spoon"
    top = text.match(docs, df, "stirring a pot").collect()
    assert top[0].task == "stirPot" and top[0].idx == 1 and top[0].score > 0
    assert text.match(docs, df, "stirring a pot", "easiest").first().idx == 0
    lost = text.match(docs, df, "qqqq zzzz").collect()
    assert len(lost) == 1 and lost[0].idx == 3 and not lost[0].confident
    same = text.scores(docs, "wipe_table wipe the table clean")
    assert same.orderBy(F.desc("score")).first().score == pytest.approx(2)
    # An empty goal is a doubtful match, as one without a common term is.
    (none,) = text.match(docs, df, " ").collect()
    assert not none.confident and none.score == 0 and none.note


def test_training(spark):
    rng = np.random.default_rng(8)
    eps = [np.cumsum(rng.normal(size=(n, 3)), axis=0) for n in (100, 40, 60, 10)]
    w = training.windows(dtw.episodes(frames(spark, eps)))
    by = {r.idx: r.n for r in w.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {0: 84, 1: 24, 2: 44}
    one = w.where("idx = 0 AND at = 5").first()
    assert np.allclose(np.reshape(one.x, (16, 3)), eps[0][5:21] - eps[0][20]) and np.allclose(one.y, eps[0][21] - eps[0][20])
    train, val = training.split(20)
    assert not set(train) & set(val) and len(val) == 4 and (train, val) == training.split(20)
    rank = {i: i for i in range(3)}
    assert training.order("curriculum", [2, 0, 1], rank, 0) == [0, 1, 2] and training.order("anti", [2, 0, 1], rank, 0) == [2, 1, 0]
    arms = spark.createDataFrame([(o, s, i, p, i == 2) for o in ("curriculum", "shuffled") for s in range(6) for p, i in enumerate(training.order(o, [0, 1], rank, s) + [2])], "ordering string, seed int, idx int, place int, is_val boolean")
    runs = store.writer(spark)(training.run_arms(w, arms))
    assert runs.count() == 12 and all(r.val_loss[-1] < r.val_loss[0] * 2 for r in runs.collect())
    assert training.bands(runs).count() > 2 and training.summarise(runs).count() == 2
    assert training.paired(runs, "auc").first().n == 6 and 0 < training.paired_p(runs, "auc", "curriculum") <= 1
    assert training.judge(-5, 0.01).startswith("better") and training.judge(-5, None).startswith("no")


# ---- the whole ----


def test_engine_and_service(spark, tmp_path):
    zarr.synthetic_set(str(tmp_path / "set"), 12, seed=7)
    engine = Engine(spark)
    poses, _ = engine.load(str(tmp_path / "set"))
    r = engine.diversity(poses)
    assert r.n == 12 and r.pairs.count() == 66 and r.curriculum.count() == 12
    ranks_ = [x.curriculum_rank for x in r.curriculum.orderBy("stage", "difficulty", "idx").collect()]
    assert ranks_ == list(range(1, 13)) and r.measures.first().n_pairs == 66
    s = Service(spark, poses)
    out = s.path("stir", seeds=2)
    assert json.loads(store.to_json(out))["candidates"][0]["task"] == "stir" and out["steps"][-1]["clip_index"] is not None
    assert len(s.trajectory("synth__stir__0001", 20)) == 20 and s.health()["status"] == "ok"
    assert s.domains()["domains"]["kitchen"] == ["stir", "wipe"]
    with pytest.raises(ValueError):
        s.graph({"speed": 1})
    seen = s.previews()
    assert [x["idx"] for x in seen] == list(range(12)) and {x["source"] for x in seen} == {"synth"}
    for x in seen:
        assert len(x["points"]) == min(240, x["n_frames"]) and np.abs(np.mean(x["points"], axis=0)).max() < 1e-9 and x["path_length"] > 0
    for wrong in ({"goal": ""}, {"goal": "stir", "seeds": 0}, {"goal": "stir", "speed": 1}):
        with pytest.raises(ValueError):
            s.path(**wrong)
    orders = {by: [x.idx for x in curriculum.row_order(r.curriculum, by).orderBy("position").collect()] for by in ("curriculum", "cluster", "dataset")}
    rows = r.curriculum.select("idx", "cluster", "curriculum_rank").collect()
    assert orders == {"curriculum": [x.idx for x in sorted(rows, key=lambda x: x.curriculum_rank)], "cluster": [x.idx for x in sorted(rows, key=lambda x: (x.cluster, x.idx))], "dataset": list(range(12))}
    assert Engine(spark).diversity(poses.where("episode_id = 'synth__stir__0001'")).n == 1
