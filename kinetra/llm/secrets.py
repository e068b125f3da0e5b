"""Secret scan: fixed patterns, and a battery of randomness tests on other long tokens.

A candidate's encoding is inferred from its characters; under the hypothesis that it is random in that alphabet, a
chi-squared test of uniformity, a runs test and a serial-correlation test are combined as in Fisher's method. As the three
depend on each other and short tokens are far from the limit laws, the p-value of the combination comes from a table for
each encoding and class of lengths, simulated once with random tokens. Natural words, names and paths are far from random:
the candidates for which the hypothesis is rejected are dropped, with the share of false rejections (lost secrets) held by
the Benjamini-Hochberg rule within bands of length and encoding. What remains is held against the alternative, too: the
letters of words joined by capitals or signs are frequent ones, so a token whose letters are as frequent as those of words
is not reported; this holds the share of false reports at any length. Only DataFrame operations are used on the documents.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spans as S
from .common import materialize

#: Base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, test of the characters, alphabet (after padding is cut and the token folded where case carries nothing)
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^(?:[a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Coefficients of a published fit of erfc, whose relative error is below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Frequencies of the letters a to z in English text, in percent.
FREQUENCIES = (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07)
WORD_TAIL = 3.1  # deviations below the mean of words: about one token in a thousand made of words is reported
LEVELS = (1, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002)  # upper tails whose quantiles a table holds
LONGEST = 16  # the last class of lengths: 256 characters and more
GRID = 64  # cells of a p-value's decimal digit, for the corpus-wide ranking


def base_spans(df: DataFrame) -> DataFrame:
    """Adds a column for each of BASE_KINDS."""
    t = F.col("text")
    df = S.find(df, "text", "assign", ASSIGN, t.contains(":") | t.contains("="))
    df = df.withColumn("assign", F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["found"], ASSIGN_VALUE, 1)) >= 6))
    return S.find(S.find(df, "text", "access", ACCESS, t.contains("AKIA")), "text", "hex", HEX)


def _tail(z, log: Callable):
    """-ln of a normal deviate's two-sided p-value; z is not negative."""
    t = 1 / (1 + z * (0.5 / 2**0.5))
    fit = ERFC[-1]
    for c in reversed(ERFC[:-1]):
        fit = t * fit + c
    return z * z * 0.5 - fit - log(t)


def battery(token: Column) -> Column:
    """encoding (null: none fits), length and combined statistic of a token, in one struct."""
    bare = F.rtrim(token, F.lit("="))
    n = F.char_length(bare).cast("double")
    out = None
    for name, rule, alphabet in reversed(ENCODINGS):
        k = len(alphabet)
        t = F.lower(bare) if name in ("hex", "base36") else bare
        letters = F.array(*(F.lit(c) for c in alphabet))
        squares = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.pow(n - F.char_length(F.replace(t, c, F.lit(""))).cast("double"), F.lit(2.0)))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        halves = F.translate(t, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
        changes = sum(((n - F.char_length(F.replace(halves, F.lit(x), F.lit(""))).cast("double")) / 2 for x in ("01", "10")), F.lit(0.0))
        runs = (changes - (n - 1) / 2) * 2 / F.sqrt(n - 1)
        mid, var = (k - 1) / 2, (k * k - 1) / 12
        values = F.transform(F.split(t, ""), lambda c: F.instr(F.lit(alphabet), c) - 1.0 - mid)
        product = F.aggregate(F.zip_with(values, F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
        serial = product / (var * F.sqrt(n))
        deviates = F.array(F.greatest(chi, F.lit(0.0)), F.abs(runs), F.abs(serial))
        total = F.aggregate(deviates, F.lit(0.0), lambda acc, z: acc + _tail(z, F.log))
        test = F.when(bare.rlike(rule), F.struct(F.lit(name).alias("encoding"), n.cast("int").alias("length"), total.alias("statistic")))
        out = test if out is None else test.otherwise(out)
    return out


def _statistics(tokens: np.ndarray, k: int) -> np.ndarray:
    """The battery's statistic of each row of numbers 0..k-1."""
    m, n = tokens.shape
    counts = np.bincount((np.arange(m)[:, None] * k + tokens).ravel(), minlength=m * k).reshape(m, k).astype(float)
    chi = ((counts**2).sum(1) * k / n - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    upper = tokens >= k // 2
    runs = ((upper[:, 1:] != upper[:, :-1]).sum(1) - (n - 1) / 2) * 2 / np.sqrt(n - 1)
    v = tokens - (k - 1) / 2
    serial = (v[:, 1:] * v[:, :-1]).sum(1) / ((k * k - 1) / 12 * np.sqrt(n))
    return sum(_tail(z, np.log) for z in (np.maximum(chi, 0), np.abs(runs), np.abs(serial)))


@functools.cache
def tables(draws: int = 6000, seed: int = 5) -> str:
    """For each band, as JSON, the pieces (start, width, slope) of a broken line from the statistic to -ln of its p-value.

    The corners are quantiles of random tokens at LEVELS; the last piece goes on for ever, as the tail is nearly exponential.
    """
    rng, out = np.random.default_rng(seed), {}
    for name, _, alphabet in ENCODINGS:
        for c in range(8, LONGEST + 1):
            n = round((max(20, 2 ** (c / 2)) + 2 ** ((c + 1) / 2)) / 2)
            x = np.quantile(_statistics(rng.integers(0, len(alphabet), (draws, n)), len(alphabet)), [1 - p for p in LEVELS])
            x[0], y = 0.0, -np.log(LEVELS)
            pieces = [[a, b - a, (v - u) / max(b - a, 1e-9)] for a, b, u, v in zip(x, x[1:], y, y[1:])]
            far = (y[-1] - y[3]) / max(x[-1] - x[3], 1e-9)
            out[f"{name}/{c}"] = [*pieces, [x[-1], 1e300, far]]
    return json.dumps(out)


def p_value(test: Column) -> Column:
    """p-value of a battery() struct under the hypothesis that the token is random in its alphabet."""
    lines = F.from_json(F.lit(tables()), "map<string,array<array<double>>>")
    line = F.element_at(lines, _band(test["encoding"], test["length"]))
    minus_log = F.aggregate(line, F.lit(0.0), lambda acc, g: acc + g[2] * F.greatest(F.lit(0.0), F.least(test["statistic"] - g[0], g[1])))
    return F.exp(-minus_log)


def _band(encoding: Column, length: Column) -> Column:
    """Encoding and class of lengths; a class spans half an octave."""
    return F.concat_ws("/", encoding, F.greatest(F.lit(8), F.least(F.lit(LONGEST), F.floor(F.log2(length.cast("double")) * 2))).cast("string"))


def _cell(p: Column) -> Column:
    return F.floor(F.least(-F.log10(F.greatest(p, F.lit(1e-30))), F.lit(30.0)) * GRID).cast("int")


def wordlike(token: Column) -> Column:
    """Whether the letters of a token are as frequent as those of words; false where only a to f occur.

    The statistic is the sum of ln(26 f) over the letters, f their frequency in text. Words have a positive mean and random
    letters a negative one; the limit is WORD_TAIL deviations below the mean of words of that many letters.
    """
    f = np.array(FREQUENCIES) / sum(FREQUENCIES)
    w = np.log(26 * f)
    mean = float(f @ w)
    spread = float(np.sqrt(f @ (w - mean) ** 2))
    folded = F.lower(token)
    size = F.char_length(folded)
    counts = [size - F.char_length(F.replace(folded, F.lit(c), F.lit(""))) for c in _LOWER]
    letters = sum(counts[1:], counts[0]).cast("double")
    total = sum((c * float(v) for c, v in zip(counts, w)), F.lit(0.0))
    return folded.rlike("[g-z]") & (total >= letters * mean - F.sqrt(letters) * (WORD_TAIL * spread))


def thresholds(candidates: DataFrame, rate: float) -> dict[str, int]:
    """For each band the least cell that is still rejected, by Benjamini and Hochberg's rule over all candidates.

    p-values are counted in cells first, so what is ranked has at most 30 * GRID rows a band, however many candidates.
    """
    cells = candidates.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("band").orderBy(F.desc("cell"))
    ranked = cells.withColumn("rank", F.sum("n").over(best)).withColumn("m", F.sum("n").over(W.partitionBy("band")))
    met = ranked.where(F.pow(F.lit(10.0), -F.col("cell") / GRID) <= F.col("rank") * rate / F.col("m"))
    return {r["band"]: r["cell"] for r in met.groupBy("band").agg(F.min("cell").alias("cell")).collect()}  # a row a band


def secret_scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, base (spans of the fixed patterns), added (spans by randomness).

    Null and empty texts have no spans. Repeated rows repeat their spans and count as often in the ranking. A span of the
    battery that overlaps a base span is left out. Candidates have 20 characters or more, and a digit or letters of both
    cases: in one case alone, words cannot be told from random letters at such lengths. Tokens whose letters are as frequent
    as those of words are left out (wordlike()): of random tokens, few of 20 characters and fewer of longer ones. Other
    columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wide = S.find(base_spans(src), "text", "random", CANDIDATE).select("doc_id", F.concat(*BASE_KINDS).alias("base"), F.filter("random", lambda s: s["found"].rlike("[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]")).alias("c"))
    tested = wide.select("doc_id", "base", F.transform(S.apart(F.col("c"), F.col("base")), lambda s: F.struct(s.alias("span"), battery(s["found"]).alias("test"))).alias("c"))
    ready = tested.select(
        "doc_id", "base",
        F.transform(F.filter("c", lambda x: x["test"].isNotNull()), lambda x: F.struct(x["span"].alias("span"), _band(x["test"]["encoding"], x["test"]["length"]).alias("band"), _cell(p_value(x["test"])).alias("cell"))).alias("c"),
    )
    scanned = materialize(ready, "secrets")
    limit = thresholds(scanned.select(F.explode("c").alias("x")).select("x.band", "x.cell"), rate)
    limits = F.create_map(*(x for k, v in limit.items() for x in (F.lit(k), F.lit(v)))) if limit else F.lit(None).cast("map<string,int>")
    kept = F.filter("c", lambda x: (x["cell"] < F.coalesce(F.try_element_at(limits, x["band"]), F.lit(1 << 30))) & ~wordlike(x["span"]["found"]))
    return scanned.select("doc_id", "base", F.transform(kept, lambda x: x["span"]).alias("added"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *(S.count(base, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(S.digest(base, BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        S.digest(F.concat("base", "added"), KINDS).alias("spans"),
    )
