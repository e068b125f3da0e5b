"""Goal matching: TF-IDF over character and word n-grams, as joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TARGET_SELECTIONS, one_of

MIN_SCORE, MIN_MARGIN = 0.35, 0.20  # fixed values: below them a match is doubtful


def document(*fields: Column) -> Column:
    """Fields as one searchable text: camel case split, lower case, everything but a-z and 0-9 a space, one space at a time."""
    joined = F.concat_ws(" ", *fields)
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(joined, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "))


def grams(text: Column) -> Column:
    """(kind, term) of a text: n-grams of 3 to 5 characters of each word with a space on either side, and runs of one and two words of two characters or more."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def pieces(n: int) -> Column:
        # a padded word shorter than n is one term, once
        return F.flatten(F.transform(padded, lambda w: F.when(F.char_length(w) > n, F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda i: w.substr(i, F.lit(n)))).otherwise(
            F.when((F.char_length(w) == n) | (F.lit(n) == 3) , F.array(w)).otherwise(F.array().cast("array<string>")))))

    long_ = F.filter(words, lambda w: F.char_length(w) >= 2)
    two = F.zip_with(F.slice(long_, 1, F.greatest(F.size(long_) - 1, F.lit(0))), F.slice(long_, 2, F.greatest(F.size(long_) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    tag = lambda kind, terms: F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    return F.concat(*(tag("char", pieces(n)) for n in (3, 4, 5)), tag("word", long_), tag("word", two))


def term_counts(docs: DataFrame) -> DataFrame:
    """idx, kind, term, tf of docs (idx, doc)."""
    return docs.select("idx", F.explode(grams(F.col("doc"))).alias("g")).select("idx", "g.kind", "g.term").groupBy("idx", "kind", "term").agg(F.count(F.lit(1)).alias("tf"))


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, kind, term, w), each document's weights of unit length, and (kind, term, idf): idf = ln((1 + n) / (1 + df)) + 1 and tf = 1 + ln tf."""
    counts = term_counts(docs)
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    idf = counts.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("kind", "term", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, ["kind", "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = raw.groupBy("idx", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return raw.join(norm, ["idx", "kind"]).select("idx", "kind", "term", (F.col("w") / F.col("_norm")).alias("w")), idf


def scores(docs: DataFrame, goal: str) -> DataFrame:
    """idx, score of every document: the sum of the two cosines with the goal, 0..2; 0 without a common term."""
    weights, idf = index(docs)
    one = docs.sparkSession.createDataFrame([(0, goal)], "idx int, raw string").select("idx", document(F.col("raw")).alias("doc"))
    q = term_counts(one).join(idf, ["kind", "term"]).withColumn("q", (1 + F.ln("tf")) * F.col("idf"))
    q = q.select("kind", "term", (F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy("kind")))).alias("q"))  # as long as the goal
    hit = weights.join(F.broadcast(q), ["kind", "term"]).groupBy("idx").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
    return docs.select("idx").join(hit, "idx", "left").select("idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def rank_tasks(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best tasks of scored (idx, task, score): task, score (its best clip's), margin over the next one, place."""
    w = W.orderBy(F.desc(F.round("score", 9)), "task")  # a row a task
    by = scored.groupBy("task").agg(F.max("score").alias("score"))
    nxt = F.coalesce(F.lead("score").over(w), F.lit(0.0))
    return by.select("task", "score", F.row_number().over(w).alias("place"), F.when(F.col("score") > 0, (F.col("score") - nxt) / F.col("score")).otherwise(0.0).alias("margin")).where(F.col("place") <= k)


def representative(clips: DataFrame, how: str = "hardest", totals: DataFrame | None = None) -> DataFrame:
    """task, idx: each task's hardest, easiest or most central clip of clips (idx, task, difficulty); ties by idx. totals (idx, total) are sums of distances within a task."""
    one_of("target_selection", how, TARGET_SELECTIONS)
    d = F.coalesce("difficulty", F.lit(1.0))
    if how == "medoid":
        clips, key = clips.join(totals, "idx"), F.struct(F.round("total", 9), "idx")
    else:
        key = F.struct(-d if how == "hardest" else d, "idx")
    return clips.groupBy("task").agg(F.min_by("idx", key).alias("idx"))


def match(docs: DataFrame, clips: DataFrame, goal: str, how: str = "hardest", k: int = 5, totals: DataFrame | None = None) -> DataFrame:
    """The candidates for a goal: place, task, score, margin, idx (target clip), confident, note. With no common term at all, as for an empty goal, the hardest clip of all is the one candidate."""
    ranked = rank_tasks(scores(docs, goal).join(clips, "idx").select("idx", "task", "score"), k).join(representative(clips, how, totals), "task")
    ranked = ranked.withColumn("confident", (F.col("score") >= MIN_SCORE) & (F.col("margin") >= MIN_MARGIN))
    none = clips.orderBy(F.desc(F.coalesce("difficulty", F.lit(1.0))), "idx").limit(1).select("task", F.lit(0.0).alias("score"), F.lit(1).alias("place"), F.lit(0.0).alias("margin"), "idx", F.lit(False).alias("confident"))
    known = ranked.where("score > 0").select("task", "score", "place", "margin", "idx", "confident")
    best = known.agg(F.count(F.lit(1)).alias("_k"))
    both = known.withColumn("note", F.when(~F.col("confident"), "weak or ambiguous match")).unionByName(none.join(F.broadcast(best)).where("_k = 0").drop("_k").withColumn("note", F.lit("nothing matches: the hardest clip is the target")))
    return both.orderBy("place")
