"""Crowds of the near-dedup join."""

import random
from collections import Counter

import numpy as np
from test_operators import brute_groups

from kinetra.llm import near_dedup


def test_a_crowd_meets_its_centre_once(spark, monkeypatch):
    # 200 texts share three quarters of their words, so that they stay together in most nodes without a link; 20 have a near copy.
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(words) for _ in range(150)]
    rows = [(i, " ".join(shared + [rng.choice(words) for _ in range(25)])) for i in range(200)]
    rows += [(1000 + i, t + f" x{i}") for i, t in rows[::10]]
    made, write = Counter(), near_dedup.materialize

    def counted(df, tag, **options):
        out = write(df, tag, **options)
        made[tag] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute_groups(dict(rows), 4, 80)
    assert len(rows) <= made["tested"] <= 8 * len(rows)


def test_pairs_count_as_compared_only_where_one_is_out():
    keys = [np.array([1, 5]), np.array([1, 5]), np.array([2, 5]), np.array([2, 5])]
    outs = [np.array([False, True]), np.array([False, False]), np.array([True, True]), np.array([False, False])]
    every = np.arange(4)
    met = near_dedup._Met(keys, outs, 5)(every, every)
    assert not met[0, 1] and not met[0, 2] and met[2, 3] and met[3, 2]
