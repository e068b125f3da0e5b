"""Personal data: fixed patterns, and gradient-boosted trees over further candidates.

High-recall generators propose spans of several kinds, which may overlap; each candidate gets features of its format and
of the text around it; boosted trees give it a score, and calibrated thresholds for each kind select what is redacted.
The trees are trained here, on a seeded synthetic set, and applied as one SQL expression: only DataFrame operations run on
the documents.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S

#: Base patterns. The looks behind and the possessive quantifiers change no match, but keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Generators of further candidates. None starts or ends within a longer run of letters and digits.
GENERATORS = {
    "ssn": r"(?<![A-Za-z0-9])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "tel": r"(?<![A-Za-z0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "national": r"(?<![A-Za-z0-9])0[0-9](?:[ ./-]?[0-9]){6,12}(?![A-Za-z0-9])",
    "passport": r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])",
    "birth": r"(?<![A-Za-z0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![A-Za-z0-9])",
}
KINDS = (*BASE_KINDS, *GENERATORS)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits of a string pass Luhn's check: every second one from the right counts twice, less 9 beyond 9."""
    back = F.split(F.reverse(_digits(found)), "")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(back, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _digits_within(low: int, high: int):
    return lambda s: F.char_length(_digits(s["found"])).between(low, high)


def base_spans(df: DataFrame) -> DataFrame:
    """Adds a column for each of BASE_KINDS, failing matches dropped."""
    t = F.col("text")
    df = S.find(df, "text", "email", EMAIL, t.contains("@"))
    df = S.find(df, "text", "ip", IP, t.contains("."))
    df = df.withColumn("ip", F.filter("ip", lambda s: F.forall(F.split(s["found"], r"\."), lambda x: F.char_length(F.ltrim(x, F.lit("0"))).between(0, 3) & (F.substring(F.concat(F.lit("000"), x), -3, 3).cast("int") <= 255))))
    df = S.find(df, "text", "card", CARD)
    df = df.withColumn("card", F.filter("card", lambda s: _digits_within(14, 19)(s) & luhn(s["found"])))
    df = S.find(df, "text", "phone", PHONE, t.contains("+"))
    return df.withColumn("phone", F.filter("phone", _digits_within(10, 15)))


def _iban_rest(found: Column) -> Column:
    """The number of an IBAN (first four characters moved to the end, letters as 10..35) modulo 97."""
    bare = F.replace(found, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4)), "")
    return F.aggregate(
        F.transform(chars, lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1),
        F.lit(0), lambda acc, v: F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97,
    )


#: Features of a candidate, each a number; kind, found, before and after are its fields.
FEATURES = {
    "is_ssn": lambda s: (s["kind"] == "ssn").cast("double"),
    "is_iban": lambda s: (s["kind"] == "iban").cast("double"),
    "is_national": lambda s: (s["kind"] == "national").cast("double"),
    "is_passport": lambda s: (s["kind"] == "passport").cast("double"),
    "is_birth": lambda s: (s["kind"] == "birth").cast("double"),
    "digits": lambda s: F.char_length(_digits(s["found"])).cast("double"),
    "distinct": lambda s: F.size(F.array_distinct(F.split(_digits(s["found"]), ""))).cast("double"),
    "glued_left": lambda s: s["before"].rlike(r"[A-Za-z0-9#/=_.-]$").cast("double"),
    "glued_right": lambda s: s["after"].rlike(r"^(?:[A-Za-z0-9/=_-]|\.[0-9])").cast("double"),
    "cue": lambda s: F.when(s["kind"] == "ssn", s["before"].rlike(r"(?i)\b(?:ssn|social|security|tax|id)\b"))
    .when(s["kind"] == "iban", s["before"].rlike(r"(?i)\b(?:iban|account|bank|transfer|konto|cuenta|compte)\b"))
    .when(s["kind"] == "passport", s["before"].rlike(r"(?i)\b(?:passport|passeport|pasaporte|reisepass|pass)\b"))
    .when(s["kind"] == "birth", s["before"].rlike(r"(?i)\b(?:born|birth|birthday|dob|geboren|geburtsdatum|n\u00e9e?|naissance|nacid[oa]|nacimiento)\b"))
    .otherwise(s["before"].rlike(r"(?i)\b(?:tel|t\u00e9l|telefon|tel[e\u00e9]fono|phone|call|fax|mobile?|cell|handy|contact|kontakt|ring)\b"))
    .cast("double"),
    "counter_cue": lambda s: s["before"].rlike(r"(?i)\b(?:order|ref|isbn|part|serial|item|invoice|rechnung|facture|factura|case|version|sku)\b").cast("double"),
    "quantity": lambda s: (s["before"].rlike(r"(?i)\b(?:total|sum|count|amount|quantity|timestamp|unix|number of|summe|menge|somme|suma)\b") | s["after"].rlike(r"(?i)^\s?(?:units?|pieces|items|bytes|rows|seconds|ms|km|kg|eur|usd|dollars|st\u00fcck)\b")).cast("double"),
    "valid": lambda s: F.when(s["kind"] == "ssn", s["found"].rlike(r"^(?!000|666|9)[0-9]{3}[ -](?!00)[0-9]{2}[ -](?!0000)[0-9]{4}$"))
    .when(s["kind"] == "iban", _iban_rest(s["found"]) == 1)
    .when(s["kind"] == "national", F.char_length(_digits(s["found"])).between(9, 12))
    .when(s["kind"] == "passport", F.char_length(s["found"]).between(8, 9))
    .when(s["kind"] == "birth", s["found"].rlike(r"^(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))$"))
    .otherwise(s["found"].rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"))
    .cast("double"),
    "even": lambda s: s["found"].rlike(r"^(?:[^ -]*|[^ ]*|[^-]*|\(.*)$").cast("double"),
}


def _candidates(df: DataFrame) -> DataFrame:
    """Adds column candidates: spans of all generators with their features."""
    has_digits = F.col("text").rlike("[0-9]{2}")
    for kind, pattern in GENERATORS.items():
        df = S.find(df, "text", kind, pattern, has_digits)
    return df.withColumn("candidates", F.transform(F.concat(*GENERATORS), lambda s: F.struct(s.alias("span"), F.array(*(f(s) for f in FEATURES.values())).alias("x")))).drop(*GENERATORS)


def _iban(rng: random.Random, valid: bool) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB", "IT", "NL"]), "".join(rng.choice("0123456789") for _ in range(18))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    check = 98 - number % 97
    raw = f"{country}{check if valid else (check % 97 + rng.randint(1, 95)) % 97 + 2:02d}{body}"
    return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if rng.random() < 0.5 else raw


def _number(rng: random.Random, kind: str, valid: bool) -> str:
    """A candidate of a kind; valid tells whether its format passes the kind's own rule."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    if kind == "ssn":
        sep, area = rng.choice("- "), rng.randint(1, 665) if valid else rng.choice([0, 666, 900, rng.randint(901, 999)])
        return f"{area:03d}{sep}{rng.randint(1, 99):02d}{sep}{rng.randint(1, 9999):04d}"
    if kind == "iban":
        return _iban(rng, valid)
    if kind == "tel":
        sep, first = rng.choice("-. "), lambda: str(rng.randint(2, 9) if valid else rng.randint(0, 1))
        return f"{first()}{d(2)}{sep}{first()}{d(2)}{sep}{d(4)}"
    if kind == "passport":
        return "".join(rng.choice("ABCDEFGHKLMNPRSTUXYZ") for _ in range(rng.randint(1, 2))) + (d(7) if valid else d(6 if rng.random() < 0.5 else 8))
    if kind == "birth":
        day, month, year = f"{rng.randint(1, 28):02d}", f"{rng.randint(1, 12):02d}", str(rng.randint(1930, 2020) if valid else rng.choice([1000, 2100]) + rng.randint(0, 99))
        return f"{year}-{month}-{day}" if rng.random() < 0.4 else rng.choice("./-").join((day, month, year))
    raw, sep = "0" + str(rng.randint(1, 9)) + d(rng.randint(7, 10) if valid else rng.choice([6, 11, 12])), rng.choice(["", " ", "/", "-", "."])
    return raw[:3] + sep + raw[3:] if rng.random() < 0.5 else sep.join(raw[i : i + 2] for i in range(0, len(raw), 2))


def synthetic(n: int = 3000, seed: int = 7) -> list[tuple[int, str, str, int]]:
    """Rows (id, kind, text, label) with one intended candidate each: personal data with and without cues, and look-alikes.

    The label is drawn first, and no single feature is the label: look-alikes often have a valid format, and then only the
    text around them tells; personal data sometimes has an odd format beside a cue. Only account numbers with a wrong
    check number are never personal data. Dates and codes of a passport's form are common, so those are personal data
    beside a cue only.
    """
    rng, rows = random.Random(seed), []
    phones = ["call ", "tel ", "phone: ", "contact me, ", "Telefon ", "t\u00e9l ", "tel\u00e9fono "]
    cues = {"ssn": ["SSN ", "social security: ", "tax id "], "iban": ["IBAN ", "bank account: ", "transfer to "], "tel": phones, "national": phones, "passport": ["passport ", "Reisepass ", "passport no. ", "pasaporte "], "birth": ["born ", "date of birth: ", "DOB ", "geboren am ", "n\u00e9 le ", "nacida el "]}
    counted = [("total of ", ""), ("amount ", ""), ("timestamp ", ""), ("sum: ", ""), ("", " units"), ("", " pieces"), ("", " bytes"), ("count of ", " items")]
    wrong = ["order ", "ref ", "isbn ", "part no ", "serial ", "item ", "case ", "invoice ", "Rechnung ", "facture "]
    for i in range(n):
        kind, good = rng.choice(list(GENERATORS)), rng.random() < 0.5
        before, after = rng.choice(["the ", "and it is ", "words here, "]), rng.choice([" or so", ".", ", then", ""])
        if good:
            cue = kind in ("passport", "birth") or rng.random() < 0.8
            valid = kind == "iban" or not cue or rng.random() < 0.9
            before += rng.choice(cues[kind]) if cue else ""
        else:
            valid = kind != "iban" and rng.random() < 0.5
            glued = rng.random() < 0.3
            if glued:
                before, after = before + rng.choice(wrong) + rng.choice(["#", "x-", "A/", "v="]), rng.choice(["-x", "/A", "_a"])
            elif rng.random() < 0.4:
                lead, unit = rng.choice(counted)
                before, after = before + lead, unit or after
            elif valid and kind not in ("passport", "birth") or rng.random() < 0.7:
                before += rng.choice(wrong)
        rows.append((i, kind, before + _number(rng, kind, valid) + after, int(good)))
    return rows


class Boosted:
    """Gradient boosting of depth-2 trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3):
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees: list[tuple] = []
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), 2)
            self.trees.append(tree)
            score = score + rate * self._value(tree, x)
        self.rate = rate

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
        leaf = (float(g.sum() / (h.sum() + 1.0)),)
        best = (1e-6, None, None)
        for j in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[:, j])[:-1]:
                side = x[:, j] <= cut
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (side, ~side)) - g.sum() ** 2 / (h.sum() + 1.0)
                if gain > best[0]:
                    best = (gain, j, float(cut) + 0.5)
        if best[1] is None:
            return leaf
        side = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[side], g[side], h[side], depth - 1), self._grow(x[~side], g[~side], h[~side], depth - 1))

    def _value(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._value(t, x) for t in self.trees)

    def expression(self, x: Column) -> Column:
        def node(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(tree[0] * self.rate)
            return F.when(F.element_at(x, tree[0] + 1) <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + node(t)
        return total


_trained: dict[float, tuple[Boosted, dict[str, float]]] = {}


def train(spark: SparkSession, precision: float = 0.98) -> tuple[Boosted, dict[str, float]]:
    """The trees, fitted on one half of the synthetic set, and for each kind the least score (0 or more: even odds) with that precision on the other half."""
    if precision not in _trained:
        rows = synthetic()
        got = _candidates(spark.createDataFrame(rows, "id int, kind string, text string, label int")).select("id", "label", "kind", F.expr("filter(candidates, c -> c.span.kind = kind)[0].x AS x")).where("x IS NOT NULL").orderBy("id").collect()
        x, y, kind = np.array([r["x"] for r in got], float), np.array([r["label"] for r in got], float), np.array([r["kind"] for r in got])
        half = np.arange(len(y)) % 2 == 0
        model = Boosted(x[half], y[half])
        score, cut = model.score(x[~half]), {}
        for k in GENERATORS:
            s, t = score[kind[~half] == k], y[~half][kind[~half] == k]
            ok = [v for v in np.unique(s) if v >= 0 and t[s >= v].mean() >= precision]
            cut[k] = float(min(ok, default=np.inf))
        _trained[precision] = model, cut
    return _trained[precision]


def pii(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, base (spans of the fixed patterns), added (spans the trees select).

    A selected span that overlaps a base span, or a selected one of an earlier generator, is left out. Null and empty texts
    have no spans; repeated rows repeat theirs; other columns are ignored. redact() cuts the spans out of texts.
    """
    model, cut = train(docs.sparkSession, precision)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ready = _candidates(base_spans(src)).select("doc_id", F.concat(*BASE_KINDS).alias("base"), "candidates")
    limit = F.create_map(*(x for k, v in cut.items() for x in (F.lit(k), F.lit(v))))
    # As a column of its own, or else the trees would be expanded once more wherever they are used.
    scored = ready.withColumn("candidates", F.transform("candidates", lambda c: F.struct(c["span"].alias("span"), model.expression(c["x"]).alias("score"))))
    chosen = F.transform(F.filter("candidates", lambda c: c["score"] >= F.element_at(limit, c["span"]["kind"])), lambda c: c["span"])
    picked = scored.select("doc_id", "base", S.apart(chosen, F.col("base")).alias("chosen"))
    first = F.aggregate("chosen", S.empty(), lambda acc, s: F.when(F.exists(acc, lambda o: (s["start"] < o["stop"]) & (o["start"] < s["stop"])), acc).otherwise(F.concat(acc, F.array(s))))
    return picked.select("doc_id", "base", first.alias("added"))


def redact(text: Column, items: Column) -> Column:
    """text with each span (sorted, not overlapping) replaced by its kind in brackets."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.array_sort(items), zero,
        lambda acc, s: F.struct(F.greatest(s["stop"], acc["at"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), s["kind"], F.lit("]")).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *(S.count(base, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(S.digest(base, BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        S.digest(F.concat("base", "added"), KINDS).alias("spans"),
    )
