"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetra.llm import decontaminate, exact_dedup, html_extract, license_scan, near_dedup, periodic_runs, pii, quality, secrets, sentence_pieces, sharding, toxicity, whitening

LONG = "a1b2 " * 8000 + "x" * 30000 + " " + "7" * 20000 + "."
CLASH = "kind string, tk string, n long, mark string, key string, w string, q int, id long, digest string, word string, span string, ids string, base string, c string, shard string, slot int, url string, assign string, email string, label int, score double, chunk long, row long, size int, source string"


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in CLASH.split(", "))]
    return df.select("*", *extra)


ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en"), (1, "one two three four five six seven eight nine ten eleven", "en"), (2, "One two three four five six seven eight nine ten eleven", None),
    (3, None, "en"), (4, "", "de"), (5, " \n\t ", "fr"), (None, "some text without an id", "en"), (None, None, None), (6, LONG, "en"), (7, "one two three four five six seven eight nine ten eleven", "en"), (8, "é 日本 😀 ▁ x", "es"),
]


def bench(spark):
    return spark.createDataFrame([(1, "three four five six"), (2, None), (3, ""), (None, "one two"), (1, "three four five six")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, None), (None, 1, 1), (7, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "2": lambda s, d: sentence_pieces.decode(sentence_pieces.encode(d, sentence_pieces.load()), sentence_pieces.load()),
    "3": lambda s, d: near_dedup.near_dedup(d), "4": lambda s, d: secrets.secret_scan(d), "5": lambda s, d: sharding.assign(d, "doc_id", ["a", "b"], 13), "6": lambda s, d: exact_dedup.exact_dedup(d),
    "7": lambda s, d: quality.quality(d, labels(s)), "8": lambda s, d: decontaminate.decontaminate(d, bench(s)), "9": lambda s, d: license_scan.license_scan(d), "10": lambda s, d: pii.pii(d),
    "12": lambda s, d: toxicity.toxicity(d, labels(s)), "13": lambda s, d: periodic_runs.find_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    d = docs(spark, ROWS)
    out = OPERATORS[name](spark, d).collect()
    assert sorted(map(repr, (r.doc_id for r in out))) == sorted(map(repr, (r[0] for r in ROWS)))
    assert OPERATORS[name](spark, docs(spark, [])).count() == 0


def test_decontamination_edges(spark):
    rows = decontaminate.decontaminate(docs(spark, ROWS), bench(spark)).collect()
    out = {r.doc_id: r for r in rows}
    assert (out[1].n_words, out[1].n_hit, out[1].items) == (11, 4, ["1"])
    assert (out[3].n_words, out[3].n_hit, out[3].items) == (0, 0, [])
    assert 5 in {r.n_words for r in rows if r.doc_id is None}
    twice = decontaminate.decontaminate(docs(spark, [(1, "three four five six", "x"), (1, "none of it here", "x")]), bench(spark)).collect()
    assert sorted((r.n_words, r.n_hit) for r in twice) == [(4, 0), (4, 4)]
    assert decontaminate.decontaminate(docs(spark, []), bench(spark)).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs(spark, ROWS), bench(spark).where("false")).collect()} == {0}


def test_pages(spark):
    rows = [(1, "u", "<p>x", 1), (1, "u", "<p>x", 1), (None, None, None, 2), (2, "", "", 3), (3, "v", "<" * 5000 + "<p a='", 4), (4, "w", "<article><p>" + "word " * 50000, 5)]
    out = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert html_extract.html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    labels(spark).write.parquet(f"{at}/labels.parquet")
    bench(spark).write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, d, folder)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == d.columns
    n = out.count()
    assert 0 < n <= len(ROWS)
    if name == "exact dedup":
        assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [4, 5, 6, 7, 8]
    if name == "decontamination":
        assert not {1, 2, 7} & {r.doc_id for r in out.collect()}
    assert stage(spark, d.where("false"), folder).count() == 0


def stay(spark, folder, k, rows):
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), folder)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_stages_judge_each_row_by_its_own_text(spark, folder):
    a, b, c = ("alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu")
    # Exact copies: unique texts without an id or under a repeated one stay, copies without an id go for those with one.
    rows = [(None, a, "x"), (None, a, "y"), (None, b, "x"), (5, b, "x"), (5, c, "y"), (5, c.upper(), "x"), (6, "nu", "x"), (6, "xi", "x")]
    assert stay(spark, folder, 1, rows) == sorted([(None, a), (5, b), (5, c.upper()), (6, "nu"), (6, "xi")], key=repr)
    # Near copies: one of a group stays, whatever its ids are, and another text under the same id as a copy.
    w = [f"w{i}" for i in range(80)]
    near = [" ".join([*w, x]) for x in ("p", "q", "r")]
    lone = [" ".join([*w[::-1], x]) for x in ("p", "q")]
    rows = [(1, near[0], "x"), (2, near[1], "x"), (2, a, "x"), (None, near[2], "x"), (None, lone[0], "x"), (None, lone[1], "x"), (None, b, "x")]
    out = stay(spark, folder, 2, rows)
    assert [x for x in out if x[1] not in lone] == sorted([(1, near[0]), (2, a), (None, b)], key=repr) and sum(x[1] in lone for x in out) == 1
    # Benchmark passages: only the rows that hold one go.
    rows = [(None, "say three four five six now", "x"), (None, a, "x"), (7, "three four five six", "x"), (7, b, "x")]
    assert stay(spark, folder, 3, rows) == sorted([(None, a), (7, b)], key=repr)
