"""Exact dedup on a log-structured merge index of digests.

Memtables flush sorted digest runs (one file a task, with Parquet's min/max statistics and Bloom filters); compaction
merges the runs, keeping one identifier per digest; documents whose digest occurs more than once are hits, and are
verified on the bytes of their normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bit_filter, decide, has_hit, materialize, may_be_in, row_key, scratch


#: A digest with at least this fraction (1 / HEAVY) of all rows is heavy; there are HEAVY of them at most.
HEAVY = 1000


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


class DigestIndex:
    """Log-structured merge index: digest -> smallest and largest identifier, number of rows.

    flush() writes a sorted run and never reads old ones; compact() merges all runs into one level; candidates() are the
    digests with more than one row. Each level lies in the shared folder, so a lost executor costs a task.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 8):
        self.spark, self.fan_in, self.root, self.runs = spark, fan_in, scratch(spark, "digest-index"), []
        self.written = 0

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}-{self.written}"
        self.written += 1
        df.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "200000").parquet(path)
        return path

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows: digest, id. Each task's memtable becomes one sorted run; returns the run, a row for each input row."""
        path = self._write(rows.select("digest", "id").sortWithinPartitions("digest", "id"), "run")
        self.runs.append((path, False))
        if len(self.runs) > self.fan_in:
            self.compact()
        return self.spark.read.schema("digest string, id long").parquet(path)

    def compact(self) -> DataFrame:
        """Merge all runs; map-side partial aggregation makes a hot digest one row a task before the shuffle."""
        merged = None
        for path, done in self.runs:
            if done:
                part = self.spark.read.schema("digest string, lo long, hi long, n long").parquet(path)
            else:
                part = self.spark.read.schema("digest string, id long").parquet(path).groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
            merged = part if merged is None else merged.unionByName(part)
        out = merged.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")) if len(self.runs) > 1 else merged
        path = self._write(out, "level")
        self.runs = [(path, True)]
        return self.spark.read.schema("digest string, lo long, hi long, n long").parquet(path)


def exact_dedup(docs: DataFrame, keep: str = "min", digest=sha256_digest) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    keep names the end of the identifiers that stays ("min" or "max"). Rows without a doc_id are counted and get their
    group's keep_id, but are never the ones kept, unless no row of the group has an id (then keep_id is null and they
    stay). Rows that repeat an id share its fate. Other columns are ignored. An empty table gives an empty result.

    Identifiers and sizes come from the compacted index. Only rows whose digest is a hit (or passes the hits' filter) have
    their texts read again and compared by bytes. digest maps the normalised text to its key; texts that share a key but
    differ in bytes are told apart whatever it is. Rows of digests that make up a large share of the table are matched
    with a broadcast of at most HEAVY digests, so no task holds them all.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    texts = src.select("id", ascii_lower(F.col("t")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    index = DigestIndex(spark)
    rows = index.flush(texts.select("digest", "id"))
    hits = index.compact().where("n > 1").selectExpr("digest", f"{'lo' if keep == 'min' else 'hi'} AS keep_id", "n AS size")
    filter_ = bit_filter(hits, "digest")
    bytes_ = may_be_in(texts, F.col("digest"), filter_).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialize(bytes_.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    heavy = hits.where(F.col("size") >= max(1, -(-rows.count() // HEAVY)))
    near = has_hit(rows, F.col("digest"), filter_)
    split = near.where("_hit").drop("_hit").join(F.broadcast(heavy), "digest", "left")
    light = split.where("size IS NULL").select("digest", "id").join(hits, "digest", "left")
    cols = ["id AS doc_id", "CASE WHEN size IS NULL THEN id ELSE keep_id END AS keep_id", "coalesce(size, 1L) AS group_size", "digest"]
    result = split.where("size IS NOT NULL").selectExpr(*cols).unionByName(light.selectExpr(*cols))
    if not clashes.isEmpty():
        # Different bytes under one digest: these few rows are matched on the bytes' own strong hash beside the digest.
        result = result.join(clashes, "digest", "left_anti")
        again = may_be_in(texts, F.col("digest"), bit_filter(clashes, "digest")).join(clashes, "digest", "left_semi")
        again = again.select("id", "digest", F.sha2(F.col("norm").cast("binary"), 512).alias("strong"))
        end = F.min if keep == "min" else F.max
        groups = again.groupBy("digest", "strong").agg(end("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
        result = result.unionByName(again.join(groups, ["digest", "strong"]).selectExpr("id AS doc_id", "keep_id", "size AS group_size", "digest"))
    alone = near.where("NOT _hit").selectExpr("id AS doc_id", "id AS keep_id", "1L AS group_size", "digest")
    return result.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts, the row with the largest doc_id stays, or one without an id where none has one. If
    rows repeat that id and text, the least of them stays. Rows that repeat an id with different texts are judged each by its own.
    """
    key = row_key(F.col("digest"), F.col("doc_id")).alias("_key")
    rows = exact_dedup(docs, keep="max").where("group_size > 1").groupBy(key).agg(F.bool_or("kept").alias("_one"), F.count(F.lit(1)).alias("n"))
    verdicts = materialize(rows.where("n > 1 OR NOT _one").select("_key", "_one"), "verdicts")
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return decide(docs, row_key(sha256_digest(norm), F.col("doc_id")), verdicts)
