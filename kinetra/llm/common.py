"""Shared pieces of the text operators: scratch tables, ASCII folding, word rules and a bounded membership filter."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters that separate words in the operators on ASCII-alphanumeric words (everything else is a word character).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share. Only where that is unset (tests on one machine) a folder of our own is put in."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kinetra-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kinetra/{tag}-{uuid.uuid4().hex[:12]}"


@contextmanager
def session(spark: SparkSession, settings: dict[str, object]) -> Iterator[None]:
    """Settings that hold while a table is written, and are then as they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of an Arrow batch of texts (Spark's own default is 10,000): a batch is held by the executor and by its Python worker, and texts may be long.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """materialize() in as many buckets by a key as there are shuffle partitions: whoever needs the rows of a key together reads them so, without a shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now: the name is needed no longer, the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other alphabets take the fast path, where lower() is the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    """Words of a text (null: none) under the SEPARATORS rule, lower-cased in A-Z."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATORS), "")


def row_key(digest: Column, id_: Column) -> Column:
    """A row's own key, never null: the digest of its text, and its identifier if it has one."""
    return F.concat_ws("/", digest, id_.cast("long").cast("string"))


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


FILTER_BITS = 1 << 26  # the most: 8 MB when all are set, however many keys went in
_PER_ROW = 32768  # what bitmap_construct_agg packs into a row


def bit_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A one-hash Bloom filter of keys, and its number of bits: about 32 a key, FILTER_BITS at most (8 MB in 2,048 rows), so that it can be broadcast at any number of keys. It lets some others through, never drops a key."""
    bits = _PER_ROW
    n = keys.count()
    while bits < min(32 * n, FILTER_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    table = (
        keys.where(F.col(key).isNotNull())
        .select(slot.alias("_slot"))
        .groupBy(F.floor(F.col("_slot") / _PER_ROW).alias("_bucket"))
        .agg(F.expr(f"bitmap_construct_agg(_slot % {_PER_ROW})").alias("_bits"))
    )
    return table, bits


def has_hit(df: DataFrame, key: Column, filter_: tuple[DataFrame, int]) -> DataFrame:
    """df with a column _hit: whether a row's key may be among those of bit_filter()."""
    table, bits = filter_
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.col("_s") % _PER_ROW
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    both = df.withColumn("_s", slot).join(F.broadcast(table), F.floor(F.col("_s") / _PER_ROW) == F.col("_bucket"), "left")
    return both.withColumn("_hit", F.coalesce(bit, F.lit(False))).drop("_s", "_bucket", "_bits")


def may_be_in(df: DataFrame, key: Column, filter_: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose key may be among those of bit_filter()."""
    return has_hit(df, key, filter_).where("_hit").drop("_hit")


def decide(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """docs without the rows that verdicts (_key, once; _one) names: all of a key, or all but the least one where _one.

    Only rows whose key may be among them are shuffled; all others pass where they lie.
    """
    names, filter_ = docs.columns, bit_filter(verdicts, "_key")
    keyed = has_hit(docs.withColumn("_key", key), F.col("_key"), filter_)
    judged = keyed.where("_hit").drop("_hit").join(verdicts, "_key", "left")
    once = judged.where("_one").groupBy("_key").agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    return keyed.where("NOT _hit").select(names).unionByName(judged.where("_one IS NULL").select(names)).unionByName(once)
