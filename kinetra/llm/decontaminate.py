"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is a run of consecutive item words. A document that holds a window holds every word of it, so one word of each
window is a sufficient prefix: the rarest one over all documents. Documents' words are joined with these prefix words
alone; a candidate must fit by its position (the window lies within the document) and length, and is then verified word by
word. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import decide, materialize, row_key, text_md5, words_of

#: Rows of the prefix table (about 0.5 KB each) up to which it is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def _prefixes(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """A row for each item word that is the rarest of some window: word, item_id, at (its place in the item), first and last
    (the range of those windows' starts), len (of a window), around (the item's words over the range) and base (the place of around[0]).
    """
    by_item = items.select("item_id", "item_words", F.posexplode("item_words").alias("at", "word")).join(counts, "word", "left")
    table = by_item.groupBy("item_id", "item_words").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("by_at"))
    size = F.size("item_words")
    length = F.least(F.lit(width), size)
    starts = table.withColumn("len", length).select("item_id", "item_words", "len", "by_at", F.explode(F.sequence(F.lit(0), size - length)).alias("start"))
    rarest = F.array_min(F.transform(F.slice("by_at", F.col("start") + 1, F.col("len")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))
    spans = starts.select("item_id", "item_words", "len", "start", rarest["at"].alias("at")).groupBy("item_id", "item_words", "len", "at").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    base = F.col("first")
    return spans.select(
        F.element_at("item_words", F.col("at") + 1).alias("word"), "item_id", "at", "first", "last", "len", base.alias("base"),
        F.slice("item_words", base + 1, F.col("last") - base + F.col("len")).alias("around"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_rows: int = BROADCAST_ROWS, key: Column | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_hit (words inside any occurrence of a window
    of benchmark), items (the item_ids with occurring windows, as sorted strings).

    Items of fewer words than width are one window; items and documents without words (also null ones) hit nothing.
    Repeated items count once by item_id; items without an id are left out. Rows that repeat a doc_id, or have none, are
    judged each by its own text. Other columns are ignored. A key of texts may stand for doc_id: then rows of one key are one.
    """
    row = F.monotonically_increasing_id() if key is None else F.lit(0)  # of a place in a split: the same whenever a task runs again
    src = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), row.alias("row"), words_of(F.col("text")).alias("w"))
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item_words")).where("size(item_words) > 0").distinct()
    items = materialize(items, "items")
    vocabulary = items.select(F.explode("item_words").alias("word")).distinct()
    small = items.select(F.coalesce(F.sum(F.size("item_words")), F.lit(0)).alias("n")).first()["n"] <= broadcast_rows
    near = F.broadcast if small else (lambda df: df)

    # Rarity: how often each word of the benchmark stands in all documents.
    counts = src.select(F.explode("w").alias("word")).join(near(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    prefixes = materialize(_prefixes(items, counts, width), "prefixes")

    # A mark at the end of each document carries its length through the same join; no word is empty.
    mark = docs.sparkSession.range(1).select(F.lit("").alias("word"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in prefixes.schema if f.name != "word"))
    keys = near(prefixes.unionByName(mark))
    q, at, first, last, n, base = (F.col(c) for c in ("q", "at", "first", "last", "len", "base"))
    words = src.select("doc_id", "row", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("q", "word"))
    left = F.greatest(q - (width - 1), F.lit(0))
    context = [F.size("w").alias("size"), left.alias("left"), F.slice("w", left + 1, F.lit(2 * width - 1)).alias("c")]
    # Positional bounds: the starts whose windows lie within the document.
    lo, hi = F.greatest(first, at - q), F.least(last, F.col("size") - n - q + at)
    marked = F.col("item_id").isNull()

    def fits(text: F.Column, at_left: F.Column, size: F.Column) -> F.Column:
        """Every window has the place before its prefix word or the one after it: one of them must agree before windows are compared."""
        def agrees(by: int) -> F.Column:
            return F.try_element_at(text, F.greatest(q - at_left + 1 + by, F.lit(1)).cast("int")).eqNullSafe(F.try_element_at("around", F.greatest(at - base + 1 + by, F.lit(1)).cast("int")))

        inside = F.greatest(first, at - q) <= F.least(last, size - n - q + at)
        return marked | (inside & ((n == 1) | ((first < at) & agrees(-1)) | ((last == at) & agrees(1))))

    if small:  # within one generated loop over a document's words: what leaves it is a candidate with the words around it
        places = words.join(keys, "word").where(fits(F.col("w"), F.lit(0), F.size("w"))).select("doc_id", "row", "q", *prefixes.drop("word").columns, *context)
    else:  # the words around a place travel with it
        places = words.select("doc_id", "row", "q", "word", *context).join(keys, "word").where(fits(F.col("c"), F.col("left"), F.col("size"))).drop("word")
    # A row for each window to compare; as a generator, not a lambda, it stays within the generated code.
    tried = places.select("*", F.explode(F.when(marked, F.array(F.lit(0))).otherwise(F.sequence(lo, hi))).alias("s"))
    s = F.col("s")
    same = F.slice("c", (q - at + s - F.col("left") + 1).cast("int"), n) == F.slice("around", (s - base + 1).cast("int"), n)
    begin = (q - at + s).cast("int")
    per = tried.where(marked | same).select("doc_id", "row", "item_id", F.when(marked, q).alias("n_words"), F.when(~marked, F.struct(begin.alias("a"), (begin + n).alias("b"))).alias("span"))
    # Aggregated before the shuffle; what is gathered for a document is bounded by its length and the items it holds.
    grouped = per.groupBy("doc_id", "row").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    # Spans in order of their starts: each adds what lies beyond those before it.
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("int").alias("to"))
    hit = F.aggregate(
        "spans", zero,
        lambda acc, x: F.struct((acc["hit"] + F.greatest(x["b"] - F.greatest(x["a"], acc["to"]), F.lit(0))).cast("long").alias("hit"), F.greatest(acc["to"], x["b"]).cast("int").alias("to")),
        lambda acc: acc["hit"],
    )
    return grouped.select("doc_id", "n_words", hit.alias("n_hit"), "items")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS text FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS text FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.text = win.text),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with any hit go, each judged by its own text, also where ids repeat or are null."""
    key = row_key(text_md5(F.col("text")), F.col("doc_id"))
    hit = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key).where("n_hit > 0").select(F.col("doc_id").alias("_key"), F.lit(False).alias("_one"))
    return decide(docs, key, materialize(hit, "contaminated"))
