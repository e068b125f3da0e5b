"""The pipeline's stages, one after the other, each against a brute-force version on its own input."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import SF, brute_groups, fold, words

import corpus_pipeline
from kinetra.llm import quality, sentence_pieces


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def densities(spark, d, rows):
    """Scores by the textbook: shrunk covariances from the labelled rows' statistics, solved without a factor."""
    lab = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    learn = {r.doc_id for r in spark.createDataFrame([(i,) for i in rows], "doc_id long").where(quality.fold(F.col("doc_id")) > 0).collect()}
    x = {k: np.array([quality.statistics(rows[i]) for i, y in lab if y == k and i in learn]) for k in (0, 1)}
    total = len(x[0]) + len(x[1])
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = np.diag(sum(np.diag(cov[k]) * len(x[k]) for k in x) / total)

    def log_density(k, v):
        c, gap = 0.9 * cov[k] + 0.1 * pooled + 0.02 * np.eye(len(v)), v - x[k].mean(0)
        return np.log(len(x[k]) / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * gap @ np.linalg.solve(c, gap)

    at = {i: np.array(quality.statistics(t)) for i, t in rows.items()}
    return {i: 1 / (1 + np.exp(-np.clip(0.25 * (log_density(1, v) - log_density(0, v)), -500, 500))) for i, v in at.items()}


def good(spark, rows):
    return {i for i, s in densities(spark, SF, rows).items() if s >= 0.3}


def unique(spark, rows):
    return set({fold(t or ""): i for i, t in sorted(rows.items())}.values())


def apart(spark, rows):
    return {i for i, (_, least) in brute_groups({i: t or "" for i, t in rows.items()}, 5, 80).items() if i == least}


def clean(spark, rows):
    items = [words(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return {i for i, t in rows.items() if not hit(words(t or ""))}


BRUTE = [good, unique, apart, clean]


@pytest.fixture(scope="module")
def inputs(spark):
    """What goes into each stage, by brute force."""
    tables = [rows_of(spark.read.parquet(f"{SF}/documents.parquet"))]
    for keeps in BRUTE:
        left = keeps(spark, tables[-1])
        tables.append({i: t for i, t in tables[-1].items() if i in left})
    return tables


@pytest.mark.parametrize("k", range(len(BRUTE)))
def test_filtering_stage(spark, inputs, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(inputs[k])))
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns and rows_of(out) == inputs[k + 1]


def test_whole_run(spark, inputs):
    p = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    got = {r.doc_id: (r.ids, r.n_pieces) for r in corpus_pipeline.run(spark, SF).collect()}
    want = {i: p.encode(t or "") for i, t in inputs[-1].items()}
    assert got == {i: (ids, len(ids)) for i, ids in want.items()} and len(inputs[0]) > len(want) > 0


def test_scores_are_the_densities(spark, inputs):
    want = densities(spark, SF, inputs[0])
    got = {r.doc_id: r.score for r in quality.op7(spark, SF).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6
