"""Adapters: the tables at hand as motion episodes (one row a frame), distance pairs and labelled items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """events as frames: an episode a user, in order of time. idx INT, frame INT, x, y, z, dt DOUBLE."""
    e = table(spark, d, "events")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")
    return e.select(
        F.col("user_id").cast("int").alias("idx"),
        (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame"),
        F.col("value").alias("x"), (second / 86400.0).alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"),
        (1.0 / F.when(F.col("user_id") % 2 == 0, 30.0).otherwise(60.0)).alias("dt"),
    )


#: The same frames for DuckDB.
EVENT_FRAMES_SQL = """frames AS (SELECT CAST(user_id AS INT) AS idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, value AS x,
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0::DOUBLE AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z, 1.0::DOUBLE / CASE WHEN user_id % 2 = 0 THEN 30.0 ELSE 60.0 END AS dt FROM events)"""


def event_meta(spark: SparkSession, d: str) -> DataFrame:
    """A row an episode: idx, episode_id, task_name (most frequent event type, ties by name), source, embodiment."""
    e = table(spark, d, "events")
    counts = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    task = counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("task_name"))
    u = F.col("user_id")
    return task.select(u.cast("int").alias("idx"), F.concat(F.lit("src"), (u % 4).cast("string"), F.lit("__user"), u.cast("string")).alias("episode_id"), "task_name", F.concat(F.lit("src"), (u % 4).cast("string")).alias("source"), F.concat(F.lit("body"), (u % 3).cast("string")).alias("embodiment"))


EVENT_META_SQL = """meta AS (SELECT CAST(user_id AS INT) AS idx, 'src' || (user_id % 4) || '__user' || user_id AS episode_id, event_type AS task_name, 'src' || (user_id % 4) AS source, 'body' || (user_id % 3) AS embodiment
  FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1)"""


#: Rows of poses that a task sorts, on average.
POSES_A_TASK = 250_000


def lineitem_poses(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as raw poses at volume: an episode a supplier, two arms by line status, returned lines as lost frames (all zero), every seventh supplier in thousandths of a unit, every eleventh standing still.

    Rows are dealt out by episode and arm once, for all that follows, to as many tasks as their number asks for: what a
    task sorts stays the same, however large the table.
    """
    li = table(spark, d, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // POSES_A_TASK))
    order = W.partitionBy("episode_id", "arm", "l_linestatus").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    s = F.col("l_suppkey")
    lost, still, scale = (F.col("l_returnflag") == "R") & (s % 5 != 0), s % 11 == 0, F.when(s % 7 == 0, 1000.0).otherwise(1.0)
    xyz = lambda c, by: F.when(lost, 0.0).when(still, F.lit(0.5)).otherwise(F.col(c) / by * scale)
    episode, arm = F.concat(F.lit("supplier__"), s.cast("string")), F.when(F.col("l_linestatus") == "O", "left").otherwise("right")
    rows = li.select("l_suppkey", "l_linestatus", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", episode.alias("episode_id"), arm.alias("arm"))
    return rows.repartition(parts, "episode_id", "arm").select(
        "episode_id", "arm",
        (F.row_number().over(order) - 1).alias("frame"), xyz("l_quantity", 50.0).alias("x"), xyz("l_extendedprice", 100000.0).alias("y"), xyz("l_discount", 0.1).alias("z"),
        (F.lit(150) + s.cast("int") % 200).alias("total_frames"),
    )


LINEITEM_POSES_SQL = """poses AS (SELECT 'supplier__' || l_suppkey AS episode_id, CASE WHEN l_linestatus = 'O' THEN 'left' ELSE 'right' END AS arm,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INT) AS frame,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 <> 0 THEN 0.0 WHEN l_suppkey % 11 = 0 THEN 0.5 ELSE l_quantity / 50.0 * s END AS x,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 <> 0 THEN 0.0 WHEN l_suppkey % 11 = 0 THEN 0.5 ELSE l_extendedprice / 100000.0 * s END AS y,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 <> 0 THEN 0.0 WHEN l_suppkey % 11 = 0 THEN 0.5 ELSE l_discount / 0.1 * s END AS z,
  CAST(150 + l_suppkey % 200 AS INT) AS total_frames FROM (SELECT *, CASE WHEN l_suppkey % 7 = 0 THEN 1000.0 ELSE 1.0 END::DOUBLE AS s FROM lineitem))"""


def embedding_nodes(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as items: idx INT, v ARRAY<DOUBLE>, task INT (its label), difficulty in 0..1 by vec_id's hash, cluster = label modulo 4, source, embodiment."""
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.cast("int").alias("idx"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("task"), (F.col("label") % 4).cast("int").alias("cluster"),
        ((i * 7919 % 1009) / 1009.0).alias("difficulty"), (i % 4).cast("int").alias("source"), (i % 3).cast("int").alias("embodiment"),
    )


NODES_SQL = """nodes AS (SELECT CAST(vec_id AS INT) AS idx, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS INT) AS task, CAST(label % 4 AS INT) AS cluster, (vec_id * 7919 % 1009) / 1009.0::DOUBLE AS difficulty, CAST(vec_id % 4 AS INT) AS source, CAST(vec_id % 3 AS INT) AS embodiment FROM embeddings)"""
PAIRS_SQL = NODES_SQL + """,
pairs AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS d FROM nodes a JOIN nodes b ON a.idx < b.idx)"""
