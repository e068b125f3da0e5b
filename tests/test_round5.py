"""Queries at sizes where an earlier form took too many rounds or too much disk."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetra.config import GraphConfig
from kinetra.operators import cluster, curriculum, dtw, graph, tiles
from kinetra.sources import store


# ---- F1: g6_repaired_graph ----


def by_hand(v, difficulty, edges, start, scale, tolerance):
    """Repairs one at a time: added edges and starts."""
    n = len(v)
    d = np.minimum(np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 6) / scale, 1)
    seen, added, starts = set(), [], []

    def reach(i):
        seen.add(i)
        for a, b in edges:
            if a == i and b not in seen:
                reach(b)

    for i in start:
        reach(i)
    while len(seen) < n:
        some = [(d[a, b], b, a) for a in seen for b in range(n) if b not in seen and difficulty[a] <= difficulty[b] + tolerance]
        if some:
            _, one, source = min(some)
            added.append((source, one))
        else:
            one = min((i for i in range(n) if i not in seen), key=lambda i: (difficulty[i], i))
            starts.append(one)
        reach(one)
    return sorted(added), sorted(starts)


@pytest.mark.parametrize("gathered", [8 << 20, 40])
def test_last_repairs_take_no_rounds(spark, monkeypatch, gathered):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(24, 2)) * 2) / 2  # many ties
    difficulty = rng.permutation(24) / 24
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 5)]
    monkeypatch.setattr(graph, "GATHERED", gathered)
    real, writes = store.writer(spark), []

    def write(df):
        writes.append(df.columns)
        return real(df)

    cfg = GraphConfig()
    nodes = real(spark.createDataFrame([(i, list(map(float, x)), float(y), i % 2) for i, (x, y) in enumerate(zip(v, difficulty))], "idx int, v array<double>, difficulty double, embodiment int"))
    flat = [F.lit(0.0).alias(c) for c in ("dtw", "difficulty_delta", "ramp_cost", "interference_cost", "redundancy_cost", "weight")]
    table = real(spark.createDataFrame(edges, "src int, dst int").select("src", "dst", *flat, F.lit(False).alias("embodiment_switch")))
    for first in (13, int(difficulty.argmax()))[: 1 + (gathered > 40)]:
        writes.clear()
        start = nodes.where(F.col("idx") == first).select("idx")
        got = graph.repair_of(nodes, table, start, cfg, write, (2.5, 0.1)).where("is_repair").select("src", "dst").collect()
        added, starts = by_hand(v, difficulty, edges, [first], 2.5, cfg.backslide_tolerance)
        assert sorted((r.src, r.dst) for r in got) == sorted([*added, *((-1, i) for i in starts)])
        assert gathered != 8 << 20 or len(writes) < 12 < len(added) + len(starts)


# ---- F2: x3_dtw_pairs ----


def test_episodes_are_sent_to_as_many_tiles_however_many_they_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t = [rng.random((int(n), 2)) for n in rng.integers(1, 7, 90)]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(t)], "idx int, traj array<array<double>>")
    monkeypatch.setattr(dtw, "SPREAD", 3)
    monkeypatch.setattr(dtw, "BATCH", 7)
    cfg = dtw.DTWConfig(block=4, normalize="none", length_normalize=False)
    pairs = dtw.pairs(table, cfg)
    assert re.findall(r"xxhash64\(idx#\d+, 42\), (\d+)", pairs._jdf.queryExecution().optimizedPlan().toString()) == ["3"]  # blocks, not 23
    got = {(r.i, r.j): r.d for r in pairs.collect()}
    assert len(got) == 90 * 89 // 2
    for i in range(90):
        for j, d in enumerate(dtw.entry_by_entry(t[i], t[i + 1 :]) if i < 89 else [], i + 1):
            assert got[i, j] == pytest.approx(d)


# ---- F4, F5, F6: g1_normalized, j6_euclidean_pairs, j7_restricted_pairs ----


@pytest.mark.parametrize("bits", [3, 12])
def test_pairs_leave_their_tile_in_order_of_distance(spark, monkeypatch, bits):
    x = np.random.default_rng(5).normal(size=(70, 3))
    x[40:50] = x[0]
    items = spark.createDataFrame([(7 * i % 1000, list(map(float, v))) for i, v in enumerate(x)], "idx int, v array<double>")
    monkeypatch.setattr(tiles, "CHUNK", 5)
    monkeypatch.setattr(tiles, "SQUARE_BITS", bits)
    monkeypatch.setattr(tiles, "SQUARE", 1 << bits)
    got = tiles.euclidean(items, side=70 if bits == 12 else 30).collect()
    want = {(7 * i, 7 * j): round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 6) for i in range(70) for j in range(i + 1, 70)}
    assert len(got) == len(want) and {(r.i, r.j): r.d for r in got} == pytest.approx(want, abs=1.1e-6)
    assert all(r.d == round(r.d, 6) for r in got)
    if bits == 12:
        assert [r.d for r in got] == sorted(r.d for r in got)


# ---- F3: x5_clusters ----


@pytest.mark.parametrize("linkage", ["average", "single"])
def test_rounds_of_merges_leave_no_table_of_pairs(spark, tmp_path, linkage, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda spark: f"file://{tmp_path}")
    rng = np.random.default_rng(9)
    pairs = spark.createDataFrame([(i, j, float(d)) for (i, j), d in zip(((i, j) for i in range(12) for j in range(i + 1, 12)), rng.permutation(66) / 8)], "i int, j int, d double")
    write = store.writer(spark)
    tree = cluster.merges(pairs, linkage, write)
    assert tree.count() == 11
    left = [spark.read.parquet(str(f)) for f in tmp_path.glob("kinetra/*/*")]
    assert not [t for t in left if "s" in t.columns and t.count()]


# ---- F7: x10_farthest_first ----


def test_what_a_pass_took_is_not_planned_as_literals(spark):
    x = np.random.default_rng(10).normal(size=(60, 4))
    real, plans = store.writer(spark), []

    def write(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    items = real(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "idx int, v array<double>"))
    got = {r.coreset_rank: r.idx for r in curriculum.coreset_prefix_of(items, None, write, 20).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    order = [int(np.round(d.sum(axis=1), 6).argmin())]
    while len(order) < 60:
        gap = d[order].min(axis=0)
        gap[order] = -1
        order.append(int(gap.argmax()))
    assert [got[k + 1] for k in range(60)] == order
    assert len(plans) > 2 and not any("INSET" in p or " IN (" in p for p in plans)


# ---- F8: p2_rehearsed_ways, by the scale of distances ----


def test_later_counting_passes_measure_what_is_within_their_ranges(spark, monkeypatch):
    x = np.random.default_rng(11).normal(size=(60, 5))
    table = pa.table({"idx": pa.array(range(60), pa.int32()), "v": pa.array(x.tolist()), **{c: pa.array([0] * 60, pa.int32()) for c in "bpq"}})
    measured, units = [], tiles.units
    monkeypatch.setattr(tiles, "units", lambda a, b, *rest: measured.append(len(a) * len(b)) or units(a, b, *rest))
    monkeypatch.setattr(tiles, "_reduced", lambda items, keys, extra, run, *rest: spark.createDataFrame(pa.table({k: pa.array(v) for k, v in run(table).items()})))
    d = np.sort(np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)[np.triu_indices(60, 1)])
    got = tiles.order_statistics(spark.createDataFrame(table.select(["idx", "v"])), {(): [0, 100, 1769]})[()]
    assert got == pytest.approx(d[[0, 100, 1769]], abs=1e-9)
    assert sum(measured) == 3600  # the first pass alone
