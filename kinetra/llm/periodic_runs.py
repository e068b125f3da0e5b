"""Periodic runs of words: stretches that repeat themselves three times or more, found by power-of-two names.

Names of blocks of 1, 2, 4, ... words come from pairs of shorter blocks' names (equal names, equal blocks; nothing is
hashed and no suffixes are sorted). A stretch of period p matches itself p words on over two periods at least, so it holds
a block that starts at a multiple of p and equals the one p words later: those pairs are the candidates. Each is extended
to both sides by walking down the levels of names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release

CHUNK = 1 << 20  # candidates at a time


def levels(ids: np.ndarray) -> list[np.ndarray]:
    """names[k][i] names the 2**k items from i on. Ends before the first level on which no block occurs twice."""
    n = len(ids)
    if not n:
        return []
    first, name, times = np.unique(ids, return_inverse=True, return_counts=True)
    again, out = times[name] > 1, []
    while again.any():
        out.append(name)
        half = 1 << (len(out) - 1)
        m = n - 2 * half + 1
        if m < 1:
            break
        at = np.flatnonzero(again[:m] & again[half : half + m])  # only what was seen twice can be seen twice again
        _, pair, times = np.unique(name[at] * (2 * n + 2) + name[at + half], return_inverse=True, return_counts=True)
        name = np.arange(m, dtype=np.int64) + len(times)
        name[at] = pair
        again = np.zeros(m, bool)
        again[at] = times[pair] > 1
    return out


def extend(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many items from i and from j on (i < j) agree, and how many just before them."""
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, step = names[k], 1 << k
        at = np.flatnonzero(j + ahead + step <= n)
        ahead[at[name[i[at] + ahead[at]] == name[j[at] + ahead[at]]]] += step
        at = np.flatnonzero(i - back >= step)
        back[at[name[i[at] - back[at] - step] == name[j[at] - back[at] - step]]] += step
    return ahead, back


def runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start and period: a stretch with smallest period q and at least max(least, times * q) items that can't be extended to either side with that period. times is 3 or more."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    n = len(ids)
    names = levels(ids) if n >= least else []
    period = np.arange(1, n // times + 1)
    length = np.maximum(least, times * period)
    level = np.frexp(length - 2 * period + 1)[1] - 1  # of the longest block that lies on a multiple of the period in any such run
    usable = level < len(names)
    period, level, length = period[usable], level[usable], length[usable]
    count = np.maximum((n - period - (1 << level)) // period + 1, 0)
    ends, found = np.cumsum(count), []
    for lo in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        c = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
        which = np.searchsorted(ends, c, side="right")
        p, x = period[which], (c - (ends[which] - count[which])) * period[which]
        same = np.zeros(len(c), bool)
        for k in np.unique(level[which]):
            at = np.flatnonzero(level[which] == k)
            same[at] = names[k][x[at]] == names[k][x[at] + p[at]]
        p, x, long_ = p[same], x[same], length[which[same]]
        ahead, back = extend(names, x, x + p, n)
        size = p + ahead + back
        keep = size >= long_
        found.append(np.unique(np.column_stack([x[keep] - back[keep], size[keep], p[keep]]), axis=0))
    best: dict[tuple[int, int], int] = {}
    for start, size, p in (r for rows in found for r in rows.tolist()):
        if p < best.get((start, size), n):  # periods of one stretch are multiples of its smallest
            best[start, size] = p
    return sorted(((s, l, p) for (s, l), p in best.items()), key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, size, p in found:
        edge[start + p] += 1
        edge[start + size] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, runs (array of start, length, period), best (the run with the greatest length for its period; ties: smallest start, then period; null without runs), collapsed (the words that stay, one space between).

    Words are what ASCII white space separates in the whole text; null and blank texts have none, no runs and an empty
    collapsed text. order(doc_id, n) may give the numbers of the words to read in place of 0..n-1. Rows without doc_id and
    repeated rows are treated like all others; other columns are ignored. A text is one task's work: it takes about 8
    bytes for each word and level of names, and levels end where no block occurs twice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                at = order(doc_id, len(words)) if order else None
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = runs(ids, least, times)
                top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                if found:
                    words = [w for w, stays in zip(words, kept(len(words), found).tolist()) if stays]
                rows.append((len(ids), found, top, b" ".join(words)))
            struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            as_row = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([[as_row(x) for x in r[1]] for r in rows], pa.list_(struct)),
                    pa.array([as_row(r[2]) for r in rows], struct), pa.array([r[3] for r in rows], pa.binary()),
                ],
                ["doc_id", "n_words", "runs", "best", "collapsed"],
            )
        release()

    one = "struct<start: long, length: long, period: long>"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs array<{one}>, best {one}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def folded(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's reading order: texts of one identifier in ten repeat a stretch of theirs to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by find_runs() in the order of folded(). Rows without doc_id are read as they are."""
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=folded)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
