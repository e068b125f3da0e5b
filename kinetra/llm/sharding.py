"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Each shard walks through the slots in an order of its own (offset and skip from its
name's hash); in turns, each claims the next slot of its order that is still free. A key's hash picks a slot, and the slot
names the shard: one lookup, even shares, and few keys that move when shards come or go.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hash(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{text}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 65537) -> list[int]:
    """The index of the shard in each slot. slots is prime and bounds the table, whatever the number of keys."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime, at least the number of shards")
    at = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key's text: 60 bits of its MD5, modulo the number of slots. A null key goes where the empty text goes."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], slots: int = 65537) -> DataFrame:
    """df with columns slot and shard (any of those names that df has are replaced). Every row gets exactly one shard.

    The table has `slots` rows of a few bytes, so it is broadcast; nothing is shuffled. Null keys share one slot, as do
    repeated keys; an empty table stays empty.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(shards[i] for i in lookup_table(shards, slots))), "_slot int, shard string").coalesce(1)
    rest = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rest.join(F.broadcast(table), F.col("slot") == F.col("_slot")).drop("_slot")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = 65537, files: int = 1) -> None:
    """Write each shard to a folder of its own, in `files` files: rows are dealt by shard and a salt from the key, so that a shard is not one task's work."""
    placed = assign(df, key, shards, slots).withColumn("_part", F.pmod(F.xxhash64(F.col(key)), F.lit(files)))
    placed.repartition(len(shards) * files, "shard", "_part").drop("_part", "slot").write.partitionBy("shard").parquet(path)


#: Production parameters of the registered query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")
