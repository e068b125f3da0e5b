"""Toxicity: maximum-scoring segments of a text's words over token log-odds, with extreme-value calibration.

A word has the score of its most telling piece: the word itself, or a beginning of it. Scores are log-odds between toxic
and other texts under Dirichlet priors, so the score of what is said by chance drifts downwards, and a passage stands out
when its sum is greater than chance sums of a text as long as that. One pass over the words finds all maximal segments;
how great their sums get by chance (Gumbel's law, its two parameters fitted on other texts) turns them into p-values.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, materialize, may_be_in, release
from .quality import fold

_WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8  # letters of a beginning
LEAST = 1.0  # sums below are no segments: less than e times likelier in toxic texts
CACHED = 200_000  # words that a worker remembers


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(word: str) -> list[str]:
    """The word, ended by a mark, and its beginnings."""
    return [f"{word[:64]}\n", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


@dataclass
class Lexicon:
    """The pieces that count, with their rank by significance (0 first), and the score of each; neutral is that of all other words."""

    rank: dict[str, int]
    score: list[float] = field(default_factory=list)
    neutral: float = -0.01
    _seen: dict[str, int] = field(default_factory=dict)

    def piece(self, word: str) -> int:
        """The number of a word's most significant piece, or -1."""
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) >= CACHED:
                self._seen.clear()
            found = min((self.rank[p] for p in pieces(word) if p in self.rank), default=-1)
            self._seen[word] = found
        return found

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_seen": {}}


def segments(at: Iterable[tuple[int, float]], neutral: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, sum) of n scores, most of which are `neutral` (below 0); at has the others by place.

    Ruzzo and Tompa's scan in linear time: each positive score opens a segment, which is merged with an earlier one for as long
    as the sum before that is lower and the sum at its end is not higher. A run of positive neighbours is one segment.
    """
    open_: list[list[float]] = []  # first, last, sum before, sum at the end, number of the nearest one with a lower sum before
    total, after = 0.0, 0
    for i, score in at:
        before = total + neutral * (i - after)
        total, after = before + score, i + 1
        if score <= 0:
            continue
        new = [i, i, before, total, -1]
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][2] >= new[2]:
                k = int(open_[k][4])
            if k < 0 or open_[k][3] >= new[3]:
                new[4] = k
                open_.append(new)
                break
            new = [open_[k][0], i, open_[k][2], total, -1]
            del open_[k:]
    return [(int(a), int(b), end - start) for a, b, start, end, _ in open_]


@dataclass(frozen=True)
class Calibration:
    """Chance sums: P(greatest sum in n words > s) = 1 - exp(-k * n * exp(-lam * s)); the score is 1 / (1 + exp(-(slope * evidence + shift)))."""

    lam: float
    k: float
    slope: float
    shift: float

    def excess(self, s: np.ndarray, n: float) -> np.ndarray:
        """-ln of the number of segments with such a sum that chance has in n words."""
        return self.lam * s - np.log(self.k * max(n, 1))

    def evidence(self, sums: np.ndarray, n: int) -> float:
        """-ln p of the best of: the greatest sum, the two greatest together, and so on (Karlin and Altschul's sums), of segments that chance has less than once."""
        t = self.excess(sums, n)
        t = np.cumsum(np.sort(t[t > 0])[::-1])
        if not len(t):
            return 0.0
        r = np.arange(1, len(t) + 1)
        fact = np.cumsum(np.log(r))
        ln_p = -t + (r - 1) * np.log(np.maximum(t, 1.0)) - fact - np.append(0, fact[:-1])
        return float(max(0.0, -ln_p.min()))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -500, 500)))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    calibration: Calibration | None
    share: float  # the score of all texts where there is nothing to learn from

    def passages(self, text: str | None) -> tuple[list[str], list[tuple[int, int, float]]]:
        words = words_of(text)
        lex = self.lexicon
        hits = [(i, lex.score[p]) for i, p in enumerate(map(lex.piece, words)) if p >= 0]
        return words, [x for x in segments(hits, lex.neutral, len(words)) if x[2] >= LEAST]


def _piece_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a piece, added up within a task; a table that grows over CACHED pieces is sent on."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[p] for p in names], pa.int64()) for c in counts)], ["piece", "other", "toxic"])
        for c in counts:
            c.clear()
        return batch

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[label].update({p for w in set(words_of(text.as_py())) for p in pieces(w)})
            if len(counts[0]) + len(counts[1]) > CACHED:
                yield out()
    yield out()
    release()


def chosen(counts: DataFrame, n: tuple[int, int], most: int, false_share: float = 0.01, least: int = 3) -> list[str]:
    """The pieces whose share of texts differs between labels, most significant first, `most` at most.

    Significance is the signed root of the likelihood ratio; the cut is where the pieces expected beyond it by chance are
    false_share of those that are there, read off a histogram of all pieces that at least `least` texts hold.
    """
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    n0, n1 = float(n[0]), float(n[1])
    part = lambda x, mean: F.when(x > 0, x * F.ln(x / mean)).otherwise(0.0)
    both = (a + b) / (n0 + n1)
    g = 2 * (part(a, n1 * both) + part(b, n0 * both) + part(n1 - a, n1 * (1 - both)) + part(n0 - b, n0 * (1 - both)))
    root = F.sqrt(F.greatest(g, F.lit(0.0)))
    tested = materialize(counts.where(F.col("toxic") + F.col("other") >= least).select("piece", root.alias("z")), "toxic-pieces")
    bars = sorted(((r["z"], r["count"]) for r in tested.groupBy(F.least(F.floor(F.col("z") * 20) / 20, F.lit(40.0)).alias("z")).count().collect()), reverse=True)  # 801 rows at most
    total, seen, cut = sum(c for _, c in bars), 0, None
    for z, c in bars:
        seen += c
        if total * math.erfc(z / math.sqrt(2)) <= false_share * seen:
            cut = z
    if cut is None:
        return []
    return [r["piece"] for r in tested.where(F.col("z") >= cut).orderBy(F.desc("z"), F.desc(F.length("piece")), "piece").limit(most).collect()]


def log_odds(counts: np.ndarray, prior: float = 1000.0) -> np.ndarray:
    """Log-odds of each kind of word (rows) between toxic (column 1) and other texts (column 0), each under a Dirichlet prior of `prior` words spread like both texts together."""
    share = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * len(counts))
    rate = (counts + prior * share[:, None]) / (counts.sum(axis=0) + prior)
    return np.log(rate[:, 1]) - np.log(rate[:, 0])


def gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lam and k of P(best <= s) = exp(-k * n * exp(-lam * s)) by maximum likelihood; texts without a segment (best 0) are censored at LEAST. lam is 1, as log-odds have it in theory, with fewer than ten segments."""
    some = best >= LEAST
    best = np.maximum(best, LEAST)
    if some.sum() < 10:
        return 1.0, float((some.sum() + 0.5) / (n * np.exp(-best)).sum()) if len(n) else 1.0

    def gap(lam: float) -> float:  # derivative of the log likelihood, with k at its best for lam
        w = n * np.exp(-lam * best)
        return some.sum() / lam - best[some].sum() + some.sum() * (w * best).sum() / w.sum()

    lo, hi = 0.02, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) > 0 else (lo, mid)
    return lo, float(some.sum() / (n * np.exp(-lo * best)).sum())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (0 or more) and shift by Newton's steps; the labels are softened as Platt has it."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (t - p) - ridge * w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


def fit(texts: DataFrame, labels: DataFrame, bound: int = 40_000, most: int = 50_000) -> Model:
    """Learn from texts (doc_id, text) and labels (doc_id, label 0/1).

    About `bound` labels are learned from (all, if there are fewer), chosen by a hash of their ids, and only texts that may
    have one are shuffled; at most `most` pieces are kept. Pieces are chosen and counted on three quarters of them, by
    another hash; chance sums and the score are fitted on the rest, which the pieces don't know. Where a label is missing
    there, all rows serve for both.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    some = labels.where(place < int(min(1.0, bound / max(labels.count(), 1)) * (1 << 30)))
    known = may_be_in(texts, F.col("doc_id"), bit_filter(some, "doc_id")).join(some, "doc_id")
    known = materialize(known.select("label", "text", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0).alias("late")), "toxic-labelled")
    sizes = {(r["late"], r["label"]): r["count"] for r in known.groupBy("late", "label").count().collect()}
    n = (sizes.get((True, 0), 0) + sizes.get((False, 0), 0), sizes.get((True, 1), 0) + sizes.get((False, 1), 0))
    share = n[1] / sum(n) if sum(n) else 0.5
    if not n[0] or not n[1]:
        return Model(Lexicon({}), None, share)
    split = len(sizes) == 4
    early, late = (known.where("NOT late"), known.where("late")) if split else (known, known)
    n = (sizes[False, 0], sizes[False, 1]) if split else n
    counts = early.select("label", "text").mapInArrow(_piece_counts, "piece string, other long, toxic long").groupBy("piece").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    names = chosen(counts, n, most)
    lexicon = Lexicon({p: i for i, p in enumerate(names)})

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((len(names) + 1, 2), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                found = Counter(map(lexicon.piece, words))
                for p, m in found.items():
                    if p >= 0:
                        c[p, label] += m
                c[-1, label] += found[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(c[:, 0]), pa.array(c[:, 1])], ["p", "other", "toxic"])

    table = np.zeros((len(names) + 1, 2))
    for r in early.select("label", "text").mapInArrow(tokens, "p long, other long, toxic long").groupBy("p").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).collect():
        table[r["p"]] = r["other"], r["toxic"]
    odds = log_odds(table)
    lexicon.score, lexicon.neutral = odds[:-1].tolist(), min(float(odds[-1]), -1e-3)
    model = Model(lexicon, None, share)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words, found = model.passages(text.as_py())
                out.append((len(words), sorted((s for _, _, s in found), reverse=True)[:64]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64()))], ["label", "n", "sums"])

    seen = late.select("label", "text").mapInArrow(sums, "label int, n long, sums array<double>").collect()  # about a quarter of `bound` rows
    y = np.array([r["label"] for r in seen])
    best, size = np.array([max(r["sums"], default=0.0) for r in seen]), np.array([float(max(r["n"], 1)) for r in seen])
    lam, k = gumbel(best[y == 0], size[y == 0])
    chance = Calibration(lam, k, 0.0, 0.0)
    slope, shift = logistic(np.array([chance.evidence(np.array(r["sums"]), r["n"]) for r in seen]), y)
    return Model(lexicon, Calibration(lam, k, slope, shift), share)


def apply(docs: DataFrame, model: Model, level: float = 0.05) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, score, passages (start and end, words from 0, end exclusive; sum; expected number by chance) whose expected number is at most level."""
    fine = model.calibration
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                words, found = model.passages(text.as_py())
                sums = np.array([s for _, _, s in found])
                expected = np.exp(-fine.excess(sums, len(words))) if fine else np.ones(len(sums))
                scores.append(float(fine.score(np.array(fine.evidence(sums, len(words))))) if fine else model.share)
                spans.append([{"start": a, "end": b + 1, "sum": s, "expected": float(e)} for (a, b, s), e in zip(found, expected) if e <= level])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(passage))], ["doc_id", "score", "passages"])
        release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, passages array<struct<start: long, end: long, sum: double, expected: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = 40_000) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, held_out, score in 0..1, predicted, passages.

    Learns from labels (doc_id, toxic) of rows whose fold is not 0; nothing but the text enters a score. Null and empty
    texts have no segments and the score of a text without evidence. A row without doc_id is scored, never learned from
    and not held out. Repeated label rows weigh as often as they occur; null or other labels than 0 and 1 are left out.
    With labels of one class alone every score is that class's share, with none 0.5. Other columns are ignored.
    """
    known = labels.selectExpr("cast(doc_id as long) AS doc_id", "cast(toxic as int) AS label").where("label IN (0, 1)")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(texts, known.where(fold(F.col("doc_id")) > 0), bound)
    return apply(texts, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("passages")
