"""Every registered query and its SQL counterpart. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import DTWConfig, GraphConfig, PathConfig
from .functions.stats import signed_rank
from .operators import clean, cluster, curriculum, dtw, graph, metrics, text, tiles, training
from .operators import kinematics as kin
from .operators import pairs as P
from .sources import store
from .sources import tables as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return T.embedding_nodes(spark, d)


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return tiles.euclidean(nodes_of(spark, d))


# ---- kinematics and difficulty ----------------------------------------------------------------------------------------

_FEATURES = (
    "WITH " + T.EVENT_FRAMES_SQL + """,
l AS (SELECT *, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3, lag(z) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3 FROM frames WINDOW w AS (PARTITION BY idx ORDER BY frame)),
s AS (SELECT *, x - x1 AS dx, y - y1 AS dy, z - z1 AS dz, sqrt((x - x1) ** 2 + (y - y1) ** 2 + (z - z1) ** 2) AS step,
  (x - 2 * x1 + x2) ** 2 + (y - 2 * y1 + y2) ** 2 + (z - 2 * z1 + z2) ** 2 AS acc2, (x - 3 * x1 + 3 * x2 - x3) ** 2 + (y - 3 * y1 + 3 * y2 - y3) ** 2 + (z - 3 * z1 + 3 * z2 - z3) ** 2 AS jerk2 FROM l),
m AS (SELECT idx, dx * lag(dx) OVER w + dy * lag(dy) OVER w + dz * lag(dz) OVER w AS turn FROM s WHERE step > 1e-12 WINDOW w AS (PARTITION BY idx ORDER BY frame)),
t AS (SELECT idx, count(turn) AS turns, count(*) FILTER (turn < 0) AS back FROM m GROUP BY idx),
g AS (SELECT idx, count(*)::DOUBLE AS n, max(dt) AS dt, coalesce(sum(step), 0) AS len, sqrt((last(x ORDER BY frame) - first(x ORDER BY frame)) ** 2 + (last(y ORDER BY frame) - first(y ORDER BY frame)) ** 2 + (last(z ORDER BY frame) - first(z ORDER BY frame)) ** 2) AS net,
  avg(step) AS step_mean, max(step) AS step_max, avg(acc2) AS acc2, avg(jerk2) AS jerk2, sum(jerk2) AS jsum, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS span FROM s GROUP BY idx),
f AS (SELECT g.idx, n AS duration, len AS path_length, net AS net_displacement, len / greatest(net, len * 1e-4, 1e-12) AS tortuosity, ln(1 + len / greatest(net, len * 1e-4, 1e-12)) AS log_tortuosity,
  step_mean / dt AS mean_speed, step_max / dt AS max_speed, sqrt(acc2) / dt ** 2 AS rms_acceleration, sqrt(jerk2) / dt ** 3 AS rms_jerk,
  CASE WHEN n >= 4 AND len > 1e-12 THEN ln(1 + sqrt(jsum / dt ** 6 * dt * (n * dt) ** 5 / (len * len))) ELSE 0 END AS log_normalized_jerk, CASE WHEN turns > 0 THEN back / turns ELSE 0 END AS reversal_rate, span AS workspace_span FROM g LEFT JOIN t ON g.idx = t.idx)"""
)


def event_features(spark: SparkSession, d: str) -> DataFrame:
    return kin.features(T.event_frames(spark, d))


@query("x7_kinematic_features", _FEATURES + """ SELECT idx, duration, round(path_length, 6) AS path_length, round(net_displacement, 6) AS net_displacement, round(tortuosity, 6) AS tortuosity, round(log_tortuosity, 6) AS log_tortuosity,
 round(mean_speed, 6) AS mean_speed, round(max_speed, 6) AS max_speed, round(rms_acceleration, 3) AS rms_acceleration, round(rms_jerk, 1) AS rms_jerk, round(log_normalized_jerk, 6) AS log_normalized_jerk, round(reversal_rate, 6) AS reversal_rate, round(workspace_span, 6) AS workspace_span FROM f""")
def x7(spark, d):
    f = event_features(spark, d).drop("normalized_jerk")
    return rounded(f.withColumns({"rms_acceleration": F.round("rms_acceleration", 3), "rms_jerk": F.round("rms_jerk", 1)}))


_Z = {k: w for k, w in kin.DIFFICULTY_WEIGHTS.items()}
_SCORED = (
    _FEATURES + ", med AS (SELECT " + ", ".join(f"median({k}) AS {k}" for k in _Z) + " FROM f), mad AS (SELECT " + ", ".join(f"median(abs(f.{k} - med.{k})) AS {k}" for k in _Z) + " FROM f, med), dev AS (SELECT " + ", ".join(f"avg({k}) AS a_{k}, stddev_pop({k}) AS s_{k}" for k in _Z) + " FROM f), "
    + "z AS (SELECT f.*, " + ", ".join(f"CASE WHEN mad.{k} >= 1e-12 THEN (f.{k} - med.{k}) / (1.4826 * mad.{k}) WHEN s_{k} >= 1e-12 THEN (f.{k} - a_{k}) / s_{k} ELSE 0 END AS z_{k}" for k in _Z) + " FROM f, med, mad, dev), "
    + "q AS (SELECT *, (" + " + ".join(f"z_{k} * {w}" for k, w in _Z.items()) + f") / {sum(_Z.values())} AS difficulty_z FROM z), "
    + "r AS (SELECT *, (rank() OVER (ORDER BY round(difficulty_z, 9)) - 1 + (count(*) OVER (PARTITION BY round(difficulty_z, 9)) - 1) / 2.0) / (count(*) OVER () - 1)::DOUBLE AS difficulty FROM q)"
)


def event_scores(spark: SparkSession, d: str, scaling: str = "rank") -> DataFrame:
    return kin.difficulty(event_features(spark, d), scaling=scaling)


@query("x8_robust_z", _SCORED + " SELECT idx, " + ", ".join(f"round(z_{k}, 6) AS z_{k}" for k in _Z) + " FROM z")
def x8(spark, d):
    return rounded(kin.robust_z(event_features(spark, d), list(_Z)).select("idx", *(f"z_{k}" for k in _Z)))


@query("x9_difficulty", _SCORED + " SELECT idx, round(difficulty_z, 6) AS difficulty_z, round(difficulty, 6) AS difficulty FROM r")
def x9(spark, d):
    return rounded(event_scores(spark, d).select("idx", "difficulty_z", "difficulty"))


@query("x9_difficulty_minmax", _SCORED + " SELECT idx, round((difficulty_z - min(difficulty_z) OVER ()) / (max(difficulty_z) OVER () - min(difficulty_z) OVER ()), 6) AS difficulty FROM q")
def x9_minmax(spark, d):
    return rounded(event_scores(spark, d, "minmax").select("idx", "difficulty"))


@query("w1_average_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, round((rank() OVER (ORDER BY l_quantity) - 1 + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / (count(*) OVER () - 1)::DOUBLE, 9) AS scaled FROM lineitem")
def w1(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return rounded(kin.rank_scale(li, "l_quantity", "scaled"), 9)


_STAGES = _SCORED + ", " + T.EVENT_META_SQL + """, c AS (SELECT r.*, CAST(r.idx % 4 AS INT) AS cluster FROM r),
st AS (SELECT cluster, CAST(row_number() OVER (ORDER BY round(avg(difficulty), 9), cluster) AS INT) AS stage FROM c GROUP BY cluster),
cur AS (SELECT c.*, stage, CAST(row_number() OVER (ORDER BY stage, difficulty, idx) AS INT) AS curriculum_rank, CAST(row_number() OVER (PARTITION BY stage ORDER BY difficulty, idx) AS INT) AS stage_position FROM c JOIN st USING (cluster))"""


def event_stages(spark, d):
    return curriculum.stages(event_scores(spark, d).withColumn("cluster", (F.col("idx") % 4).cast("int")))


@query("x11_curriculum", _STAGES + " SELECT cur.idx, episode_id, task_name, source, embodiment, cluster, stage, stage_position, curriculum_rank, round(difficulty, 6) AS difficulty FROM cur JOIN meta ON cur.idx = meta.idx")
def x11(spark, d):
    cur = event_stages(spark, d).select("idx", "cluster", "stage", "stage_position", "curriculum_rank", "difficulty")
    return rounded(cur.join(T.event_meta(spark, d), "idx"))


@query("a12_stage_summary", _STAGES + " SELECT stage, count(*) AS n_episodes, round(avg(difficulty), 6) AS mean_difficulty, round(min(difficulty), 6) AS min_difficulty, round(max(difficulty), 6) AS max_difficulty, round(avg(path_length), 6) AS mean_path_length, round(avg(tortuosity), 6) AS mean_tortuosity FROM cur GROUP BY stage")
def a12(spark, d):
    return rounded(curriculum.stage_summary(event_stages(spark, d)))


@query("k9_row_orders", _STAGES + " SELECT idx, curriculum_rank - 1 AS by_curriculum, CAST(row_number() OVER (ORDER BY cluster, idx) - 1 AS INT) AS by_cluster, CAST(row_number() OVER (ORDER BY idx) - 1 AS INT) AS by_dataset FROM cur")
def k9(spark, d):
    table = store.writer(spark)(event_stages(spark, d).select("idx", "cluster", "curriculum_rank"))
    by = [curriculum.row_order(table, o).withColumnRenamed("position", f"by_{o}") for o in ("curriculum", "cluster", "dataset")]
    return by[0].join(by[1], "idx").join(by[2], "idx")


@query("b1_windows", "WITH " + T.EVENT_FRAMES_SQL + """, n AS (SELECT idx, frame, x, y, z, lead(x) OVER w - x AS nx, lead(y) OVER w - y AS ny, lead(z) OVER w - z AS nz, first_value(x) OVER v - x AS fx, frame - 15 AS "at" FROM frames WINDOW w AS (PARTITION BY idx ORDER BY frame), v AS (PARTITION BY idx ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT idx, "at", round(fx, 9) AS first_x, round(nx, 9) AS next_x, round(ny, 9) AS next_y, round(nz, 9) AS next_z FROM n WHERE "at" >= 0 AND nx IS NOT NULL""")
def b1(spark, d):
    w = training.windows(dtw.episodes(T.event_frames(spark, d)))
    return rounded(w.select("idx", "at", F.col("x")[0].alias("first_x"), F.col("y")[0].alias("next_x"), F.col("y")[1].alias("next_y"), F.col("y")[2].alias("next_z")), 9)


# ---- dynamic time warping ---------------------------------------------------------------------------------------------


@query("x3_dtw_pairs", "WITH " + T.EVENT_FRAMES_SQL + """,
e AS (SELECT idx, list([x, y, z] ORDER BY frame) AS p FROM (SELECT idx, frame, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-12 THEN 1 ELSE stddev_pop(x) OVER w END AS x, (y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w < 1e-12 THEN 1 ELSE stddev_pop(y) OVER w END AS y, (z - avg(z) OVER w) / CASE WHEN stddev_pop(z) OVER w < 1e-12 THEN 1 ELSE stddev_pop(z) OVER w END AS z FROM frames WINDOW w AS (PARTITION BY idx)) GROUP BY idx),
k AS (SELECT sqrt(avg(len(p))) AS s FROM e)
SELECT i, j, round(sqrt(r[len(r)]) / s, 5) AS d FROM (SELECT a.idx AS i, b.idx AS j, list_reduce(a.p, lambda acc, u: list_reduce(b.p, lambda row, v: list_append(row, (u[1] - v[1]) ** 2 + (u[2] - v[2]) ** 2 + (u[3] - v[3]) ** 2 + least(
   CASE WHEN len(row) = 0 THEN 'Infinity'::DOUBLE ELSE row[len(row)] END, CASE WHEN len(acc) = 0 THEN 'Infinity'::DOUBLE ELSE acc[len(row) + 1] END,
   CASE WHEN len(acc) = 0 THEN CASE WHEN len(row) = 0 THEN 0 ELSE 'Infinity'::DOUBLE END WHEN len(row) = 0 THEN 'Infinity'::DOUBLE ELSE acc[len(row)] END)), []::DOUBLE[]), []::DOUBLE[]) AS r FROM e a JOIN e b ON a.idx < b.idx), k""")
def x3(spark, d):
    return rounded(dtw.pairs(dtw.episodes(T.event_frames(spark, d)), DTWConfig()), 5)


# ---- cleaning ---------------------------------------------------------------------------------------------------------

_ARMS = "WITH " + T.LINEITEM_POSES_SQL + """,
c AS (SELECT *, count(*) OVER (PARTITION BY episode_id, arm) AS stored FROM poses),
k AS (SELECT *, (x = 0 AND y = 0 AND z = 0) AS lost FROM c WHERE NOT (total_frames > 0 AND total_frames <= stored) OR frame < total_frames),
p AS (SELECT episode_id, arm, x, y, z, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM k WHERE NOT lost WINDOW w AS (PARTITION BY episode_id, arm ORDER BY frame)),
v AS (SELECT episode_id, arm, count(*) AS n_valid, median(sqrt(x * x + y * y + z * z)) AS norm, greatest(stddev_pop(x), stddev_pop(y), stddev_pop(z)) AS std, coalesce(sum(step), 0) AS path FROM p GROUP BY ALL),
q AS (SELECT r.episode_id, r.arm, n_raw, coalesce(n_valid, 0) AS n_valid, CASE WHEN norm > 10 THEN 0.001 ELSE 1.0 END::DOUBLE AS unit_scale, std, coalesce(path, 0) AS path FROM (SELECT episode_id, arm, count(*) AS n_raw FROM k GROUP BY ALL) r LEFT JOIN v ON r.episode_id = v.episode_id AND r.arm = v.arm),
a AS (SELECT episode_id, arm, n_raw, n_valid, round(1 - n_valid / n_raw, 4) AS missing_frame_ratio, unit_scale, path * unit_scale AS activity, CASE WHEN 1 - n_valid / n_raw > 0.5 THEN 'lost' WHEN n_valid < 30 THEN 'short' WHEN std * unit_scale < 1e-3 THEN 'static' END AS cause FROM q)"""


@query("c1_c6_arm_quality", _ARMS + " SELECT episode_id, arm, n_raw, n_valid, missing_frame_ratio, unit_scale, round(activity, 5) AS activity, cause FROM a")
def c1(spark, d):
    q = clean.arm_quality(T.lineitem_poses(spark, d))
    cause = F.when(F.col("reason").contains("sentinels"), "lost").when(F.col("reason").contains("valid"), "short").when(F.col("reason").isNotNull(), "static")
    return q.select("episode_id", "arm", "n_raw", "n_valid", "missing_frame_ratio", "unit_scale", F.round("activity", 5).alias("activity"), cause.alias("cause"))


@query("c8_arm_choice", _ARMS + """ SELECT episode_id, arg_min(arm, (-round(activity, 9), arm)) FILTER (cause IS NULL) AS arm_used, coalesce(string_agg(arm, ',' ORDER BY arm) FILTER (cause IS NULL), '') AS arms_available FROM a GROUP BY episode_id""")
def c8(spark, d):
    q = clean.arm_quality(T.lineitem_poses(spark, d)).withColumn("activity", F.round("activity", 9))
    return clean.choose_arm(q).select("episode_id", "arm_used", "arms_available")


@query("c15_rejections", _ARMS + " SELECT CASE cause WHEN 'lost' THEN 'sentinel' ELSE cause END AS kind, count(*) AS n FROM a WHERE cause IS NOT NULL GROUP BY ALL")
def c15(spark, d):
    return clean.rejection_kinds(clean.arm_quality(T.lineitem_poses(spark, d)).where("reason IS NOT NULL"))


# ---- relational pieces ------------------------------------------------------------------------------------------------


@query("s9_balanced_take", "SELECT c_nationkey, c_custkey FROM customer ORDER BY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), c_nationkey LIMIT 60")
def s9(spark, d):
    return store.balanced_take(T.table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 60)


@query("s23_first_appearance", "SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY o_custkey")
def s23(spark, d):
    return store.first_seen(T.table(spark, d, "orders"), "o_custkey", "o_orderkey").withColumnRenamed("first", "first_order")


@query("j1_left_join", "SELECT c_custkey, n_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def j1(spark, d):
    c, n, o = (T.table(spark, d, t) for t in ("customer", "nation", "orders"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    full = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left").join(per, c["c_custkey"] == per["o_custkey"], "left")
    return full.select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("j10_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j10(spark, d):
    c, o = T.table(spark, d, "customer"), T.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("a20_labelled_share", "SELECT lang, count(*) AS n, count(quality) AS n_labelled FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang")
def a20(spark, d):
    docs, lab = T.table(spark, d, "documents").select("doc_id", "lang"), T.table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"))


# ---- pairs ------------------------------------------------------------------------------------------------------------

_P = "WITH " + T.PAIRS_SQL + ", sym AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs)"
_NORM = _P + ", scale AS (SELECT quantile_cont(d, 0.95) AS s FROM pairs), norm AS (SELECT i, j, d, least(d / s, 1.0) AS dn FROM pairs, scale)"


@query("j6_euclidean_pairs", _P + " SELECT i, j, d FROM pairs")
def j6(spark, d):
    return pairs_of(spark, d)


@query("a1_pair_summary", _P + " SELECT count(*) AS n_pairs, round(avg(d), 6) AS diversity_score, round(median(d), 6) AS median_pairwise, round(stddev_pop(d), 6) AS std_pairwise, min(d) AS min_pairwise, max(d) AS max_pairwise, round(stddev_pop(d) / avg(d), 6) AS dispersion, round(quantile_cont(d, 0.99) / median(d), 6) AS tail_ratio FROM pairs")
def a1(spark, d):
    return rounded(P.summary_of(nodes_of(spark, d)))


@query("a5_nearest", _P + " SELECT i AS idx, min(d) AS nn FROM sym GROUP BY i")
def a5(spark, d):
    return tiles.nearest(nodes_of(spark, d))


@query("a6_redundancy", _P + ", nn AS (SELECT i, min(d) AS nn FROM sym GROUP BY i) SELECT round(avg(nn), 6) AS mean_nn_distance, round(avg(CASE WHEN nn <= (SELECT quantile_cont(d, 0.05) FROM pairs) THEN 1.0 ELSE 0.0 END), 6) AS redundancy_ratio FROM nn")
def a6(spark, d):
    return rounded(P.redundancy_of(nodes_of(spark, d)))


@query("a7_cluster_balance", "WITH s AS (SELECT label % 4 AS c, count(*) AS n FROM embeddings GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM s) SELECT round(-sum(p * ln(p)) / ln(count(*)), 9) AS cluster_balance FROM p")
def a7(spark, d):
    return rounded(P.balance(nodes_of(spark, d)), 9)


@query("a8_silhouette", _P + """, m AS (SELECT s.i, a.cluster AS ci, b.cluster AS cj, avg(d) AS m FROM sym s JOIN nodes a ON s.i = a.idx JOIN nodes b ON s.j = b.idx GROUP BY ALL),
ab AS (SELECT i, min(m) FILTER (ci = cj) AS a, min(m) FILTER (ci <> cj) AS b FROM m GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def a8(spark, d):
    return rounded(P.silhouette_of(nodes_of(spark, d)))


@query("a9_adjusted_rand", """WITH n AS (SELECT label % 4 AS c, label AS t FROM embeddings), k AS (SELECT c, t, count(*) AS n FROM n GROUP BY ALL), a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM k GROUP BY c)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM k GROUP BY t)), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM k)
SELECT round((t.s - a.s * b.s / (t.n * (t.n - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (t.n * (t.n - 1) / 2)), 9) AS ari, CAST(t.n AS BIGINT) AS support FROM a, b, t""")
def a9(spark, d):
    return rounded(P.adjusted_rand(nodes_of(spark, d), "cluster", "task"), 9)


@query("a10_crosstab", "SELECT CAST(label % 4 AS INT) AS cluster, CAST(label AS INT) AS task, count(*) AS n FROM embeddings GROUP BY ALL")
def a10(spark, d):
    return P.crosstab(nodes_of(spark, d), "cluster", "task")


_W = ", within AS (SELECT n.idx, n.cluster, coalesce(sum(s.d) FILTER (b.cluster = n.cluster), 0) AS total FROM nodes n LEFT JOIN sym s ON s.i = n.idx LEFT JOIN nodes b ON s.j = b.idx GROUP BY ALL)"


@query("a13_medoids", _P + _W + " SELECT cluster, arg_min(idx, (round(total, 9), idx)) AS idx FROM within GROUP BY cluster")
def a13(spark, d):
    return P.medoids_of(nodes_of(spark, d))


@query("a14_global_medoid", _P + " SELECT i AS idx, round(sum(d), 4) AS total FROM sym GROUP BY i ORDER BY round(sum(d), 6), i LIMIT 1")
def a14(spark, d):
    return rounded(P.global_medoid_of(nodes_of(spark, d)), 4)


@query("k1_redundant_pairs", _P + " SELECT i, j, d FROM pairs WHERE d <= (SELECT quantile_cont(d, 0.05) FROM pairs) ORDER BY d, i, j LIMIT 50")
def k1(spark, d):
    return P.redundant_pairs_of(nodes_of(spark, d))


@query("k2_knn", _P + " SELECT i, j, d, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM sym) WHERE r <= 10")
def k2(spark, d):
    return P.nearest_items(nodes_of(spark, d), 10, digits=6)


@query("k10_stratified_turns", _P + _W + " SELECT idx, cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(total, 6), idx) AS INT) AS turn FROM within")
def k10(spark, d):
    turn = F.row_number().over(W.partitionBy("cluster").orderBy(F.round("total", 6), "idx"))
    return P.within_sums_of(nodes_of(spark, d)).select("idx", "cluster", turn.alias("turn"))


@query("j7_restricted_pairs", _P + " SELECT p.i, p.j, p.d FROM pairs p JOIN nodes a ON p.i = a.idx JOIN nodes b ON p.j = b.idx WHERE a.task < 3 AND b.task < 3")
def j7(spark, d):
    return tiles.euclidean(nodes_of(spark, d).where("task < 3"))  # what is left out is never paired


@query("x12_subset_scores", _P + """, sub AS (SELECT idx, CAST(source AS INT) AS subset FROM nodes), ins AS (SELECT a.subset, p.* FROM pairs p JOIN sub a ON p.i = a.idx JOIN sub b ON p.j = b.idx AND a.subset = b.subset), nn AS (SELECT subset, idx, min(d) AS nn FROM (SELECT subset, i AS idx, d FROM ins UNION ALL SELECT subset, j, d FROM ins) GROUP BY ALL),
n1 AS (SELECT subset, avg(nn) AS m, avg(CASE WHEN nn <= (SELECT quantile_cont(d, 0.05) FROM pairs) THEN 1.0 ELSE 0.0 END) AS r FROM nn GROUP BY subset), c AS (SELECT source AS subset, count(*) AS n, count(DISTINCT task) AS t, count(DISTINCT source) AS s, count(DISTINCT cluster) AS c FROM nodes GROUP BY source)
SELECT i.subset, c.n, round(avg(d), 6) AS diversity_score, round(median(d), 6) AS median_pairwise, min(d) AS min_pairwise, round(any_value(n1.m), 6) AS mean_nn_distance, round(any_value(n1.r), 6) AS redundancy_ratio, any_value(c.t) AS n_tasks_covered, any_value(c.s) AS n_sources_covered, any_value(c.c) AS n_clusters_covered FROM ins i JOIN n1 ON i.subset = n1.subset JOIN c ON i.subset = c.subset GROUP BY i.subset, c.n""")
def x12(spark, d):
    n = nodes_of(spark, d)
    return rounded(P.score_subsets_of(n.select(F.col("source").alias("subset"), "idx"), ["subset"], n))


# ---- the clip graph ---------------------------------------------------------------------------------------------------


@query("g1_normalized", _NORM + " SELECT i, j, round(dn, 6) AS dn FROM norm")
def g1(spark, d):
    n = nodes_of(spark, d)
    return rounded(graph.scaled(tiles.euclidean(n), tiles.quantile(n, 0.95)).select("i", "j", "dn"))


@query("g3_novelty_floor", _NORM + " SELECT round(quantile_cont(dn, 0.05), 9) AS floor FROM norm")
def g3(spark, d):
    return rounded(spark.range(1).select(F.lit(graph.scale_of(nodes_of(spark, d))[1]).alias("floor")), 9)


_EDGES = _NORM + """, fl AS (SELECT quantile_cont(dn, 0.05) AS f FROM norm), near AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM sym) WHERE r <= 10),
both_ AS (SELECT n.i AS src, n.j AS dst, dn FROM near n JOIN norm m ON n.i = m.i AND n.j = m.j UNION ALL SELECT n.j, n.i, dn FROM near n JOIN norm m ON n.i = m.i AND n.j = m.j),
c AS (SELECT src, dst, dn, b.difficulty - a.difficulty AS delta, a.task <> b.task AS ts, a.cluster <> b.cluster AS cs, a.embodiment <> b.embodiment AS es, a.source <> b.source AS ss, f FROM both_ JOIN nodes a ON src = a.idx JOIN nodes b ON dst = b.idx, fl WHERE b.difficulty - a.difficulty >= -0.05),
e AS (SELECT src, dst, dn AS dtw, delta, abs(delta - 0.05) / 0.05 + CASE WHEN delta < 0 THEN 2 * -delta / 0.05 ELSE 0 END AS ramp, dn + CASE WHEN ts THEN 0.5 ELSE 0 END + CASE WHEN cs THEN 0.3 ELSE 0 END + CASE WHEN es THEN 0.3 ELSE 0 END + CASE WHEN ss THEN 0.2 ELSE 0 END AS inter, CASE WHEN f > 1e-12 THEN greatest(0, f - dn) / f ELSE 0 END AS red, ts, cs, es, ss FROM c)"""


def edges_of(spark, d):
    return graph.candidate_edges_of(nodes_of(spark, d), GraphConfig())


@query("g4_candidate_edges", _EDGES + " SELECT src, dst, round(dtw, 6) AS dtw, round(delta, 6) AS difficulty_delta, round(ramp, 6) AS ramp_cost, round(inter, 6) AS interference_cost, round(red, 6) AS redundancy_cost, round(ramp + inter + red + 0.1, 6) AS weight, ts AS task_switch, cs AS cluster_switch, es AS embodiment_switch, ss AS source_switch FROM e")
def g4(spark, d):
    return rounded(edges_of(spark, d))


_POOL = ", q AS (SELECT quantile_cont(difficulty, 0.1) AS q FROM nodes), ec AS (SELECT cluster FROM nodes GROUP BY cluster ORDER BY round(avg(difficulty), 9), cluster LIMIT 1), pool AS (SELECT idx FROM nodes, q WHERE difficulty <= q AND cluster = (SELECT cluster FROM ec))"


@query("g5_start_pool", "WITH " + T.NODES_SQL + _POOL + " SELECT idx FROM pool")
def g5(spark, d):
    return graph.start_pool(nodes_of(spark, d))


@query("v1_domains", "SELECT label AS task, count(*) AS n_clips, count(DISTINCT vec_id % 4) AS n_sources FROM embeddings GROUP BY label")
def v1(spark, d):
    n = nodes_of(spark, d)
    return n.groupBy("task").agg(F.count(F.lit(1)).alias("n_clips"), F.countDistinct("source").alias("n_sources"))


# ---- orderings --------------------------------------------------------------------------------------------------------

_ORD = _NORM + """, ord AS (SELECT source AS k, idx, task, cluster, embodiment, source, difficulty, CAST(row_number() OVER (PARTITION BY source ORDER BY idx) AS INT) AS step FROM nodes),
hop AS (SELECT k, step, idx AS u, lead(idx) OVER w AS v, task AS tu, lead(task) OVER w AS tv, cluster AS cu, lead(cluster) OVER w AS cv, embodiment AS eu, lead(embodiment) OVER w AS ev, source AS su, lead(source) OVER w AS sv FROM ord WINDOW w AS (PARTITION BY k ORDER BY step)),
hd AS (SELECT hop.*, n.d, n.dn FROM hop JOIN norm n ON n.i = least(u, v) AND n.j = greatest(u, v) WHERE v IS NOT NULL)"""


def turns_of(spark, d):
    """Orderings by cluster, in which the source changes."""
    n = nodes_of(spark, d)
    return n.select(F.col("cluster").alias("k"), F.row_number().over(W.partitionBy("cluster").orderBy("idx")).alias("step"), "idx", F.lit(False).alias("is_review"))


def orderings_of(spark, d):
    n = nodes_of(spark, d)
    return n.select(F.col("source").alias("k"), F.row_number().over(W.partitionBy("source").orderBy("idx")).alias("step"), "idx", F.lit(False).alias("is_review"))


@query("x13_monotonicity", _ORD + """, r AS (SELECT k, step, difficulty, rank() OVER (PARTITION BY k ORDER BY difficulty) + (count(*) OVER (PARTITION BY k, difficulty) - 1) / 2.0 AS r, difficulty - lag(difficulty) OVER (PARTITION BY k ORDER BY step) AS dd FROM ord)
SELECT k, round(corr(r, step), 6) AS spearman, round(avg(CASE WHEN dd IS NULL THEN NULL WHEN dd >= -1e-12 THEN 1.0 ELSE 0.0 END), 6) AS frac_nondecreasing, round(max(dd), 6) AS max_jump, round(max(abs(dd)), 6) AS max_abs_step, round(avg(abs(dd)), 6) AS mean_abs_step, count(*) FILTER (dd > 0.15) AS n_large_jumps FROM r GROUP BY k""")
def x13(spark, d):
    return rounded(metrics.monotonicity(orderings_of(spark, d), nodes_of(spark, d), ["k"]))


@query("x15_interference", _ORD .replace("source AS k", "cluster AS k").replace("PARTITION BY source", "PARTITION BY cluster") + " SELECT k, round(avg((tu <> tv)::INT), 6) AS task_switch_rate, round(avg((cu <> cv)::INT), 6) AS cluster_switch_rate, round(avg((eu <> ev)::INT), 6) AS embodiment_switch_rate, round(avg((su <> sv)::INT), 6) AS source_switch_rate, round(avg(dn), 6) AS mean_hop, round(max(dn), 6) AS max_hop FROM hd GROUP BY k")
def x15(spark, d):
    n = nodes_of(spark, d)
    scale = tiles.quantile(n, 0.95)
    return rounded(metrics.interference(turns_of(spark, d), n, None, ["k"], lambda h: metrics.with_vectors(h, n, scale)))


@query("x16_coverage", _ORD + " SELECT k, round(count(DISTINCT cluster) / (SELECT count(DISTINCT cluster) FROM nodes), 6) AS cluster_coverage, round(count(DISTINCT task) / (SELECT count(DISTINCT task) FROM nodes), 6) AS task_coverage, count(*) AS prefix_length, count(DISTINCT cluster) AS n_clusters FROM ord GROUP BY k")
def x16(spark, d):
    return rounded(metrics.coverage(orderings_of(spark, d), nodes_of(spark, d), ["k"]))


@query("w8_coverage_curve", _ORD + ", f AS (SELECT k, step, CASE WHEN row_number() OVER (PARTITION BY k, task ORDER BY step) = 1 THEN 1 ELSE 0 END AS new FROM ord) SELECT k, step, CAST(sum(new) OVER (PARTITION BY k ORDER BY step) AS BIGINT) AS seen FROM f")
def w8(spark, d):
    return metrics.coverage_curve(orderings_of(spark, d), nodes_of(spark, d), ["k"], "task")


@query("x17_path_redundancy", _ORD + """, cut AS (SELECT quantile_cont(d, 0.05) AS c FROM pairs), ins AS (SELECT a.k, avg(p.d) AS m FROM pairs p JOIN ord a ON p.i = a.idx JOIN ord b ON p.j = b.idx AND a.k = b.k GROUP BY a.k)
SELECT hd.k, round(avg(CASE WHEN d <= c THEN 1.0 ELSE 0.0 END), 6) AS near_duplicate_share, round(any_value(ins.m), 6) AS mean_pairwise, 1.0::DOUBLE AS distinct_ratio FROM hd JOIN ins ON hd.k = ins.k, cut GROUP BY hd.k""")
def x17(spark, d):
    return rounded(metrics.path_redundancy_of(orderings_of(spark, d), nodes_of(spark, d), ["k"]))


# ---- text -------------------------------------------------------------------------------------------------------------


def clip_docs(spark, d):
    p = T.table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("int").alias("idx"), text.document(*(F.col(c).cast("string") for c, t in p.dtypes if t == "string")).alias("doc"))


_DOCS = "d AS (SELECT CAST(doc_id AS INT) AS idx, trim(regexp_replace(lower(regexp_replace(concat_ws(' ', lang, source), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS doc FROM documents)"


@query("t1_documents", "WITH " + _DOCS + " SELECT idx, doc FROM d")
def t1(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("idx"), text.document(F.col("lang"), F.col("source")).alias("doc"))


@query("t2_word_index", "WITH " + _DOCS + """, w AS (SELECT idx, unnest(string_split(doc, ' ')) AS term FROM d), c AS (SELECT idx, term, count(*) AS tf FROM w WHERE len(term) >= 2 GROUP BY ALL)
SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1, 6) AS idf FROM c GROUP BY term""")
def t2(spark, d):
    docs = t1(spark, d)
    counts = text.term_counts(docs).where("kind = 'word' AND term NOT LIKE '% %'")
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    return rounded(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", "df", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")))


def _terms_sql(docs: str) -> str:
    """The terms of a table (idx, doc): n-grams of words with a space on either side, words, and pairs of words."""
    return f"""SELECT idx, 'char' AS kind, substring(p, i, n) AS term FROM (SELECT idx, ' ' || unnest(list_filter(string_split(doc, ' '), lambda w: w <> '')) || ' ' AS p FROM {docs}), (VALUES (3), (4), (5)) v(n), generate_series(1, 100) g(i)
  WHERE i + n - 1 <= len(p)
  UNION ALL SELECT idx, 'word', w FROM (SELECT idx, unnest(string_split(doc, ' ')) AS w FROM {docs}) WHERE len(w) >= 2
  UNION ALL SELECT idx, 'word', l[i] || ' ' || l[i + 1] FROM (SELECT idx, list_filter(string_split(doc, ' '), lambda w: len(w) >= 2) AS l FROM {docs}), generate_series(1, 100) g(i) WHERE i < len(l)"""


def _scores_sql(goal: str) -> str:
    return f"""WITH {_DOCS}, goal AS (SELECT 0 AS idx, '{goal}' AS doc),
counts AS (SELECT idx, kind, term, count(*) AS tf FROM ({_terms_sql("d")}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM d),
idf AS (SELECT kind, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM counts, n GROUP BY kind, term, n),
raw AS (SELECT c.idx, c.kind, c.term, (1 + ln(tf)) * idf AS w FROM counts c JOIN idf ON c.kind = idf.kind AND c.term = idf.term),
norm AS (SELECT idx, kind, sqrt(sum(w * w)) AS length FROM raw GROUP BY ALL),
gc AS (SELECT kind, term, count(*) AS tf FROM ({_terms_sql("goal")}) GROUP BY ALL),
gw AS (SELECT gc.kind, gc.term, (1 + ln(tf)) * idf AS w FROM gc JOIN idf ON gc.kind = idf.kind AND gc.term = idf.term),
q AS (SELECT kind, term, w / sqrt(sum(w * w) OVER (PARTITION BY kind)) AS q FROM gw),
hit AS (SELECT raw.idx, sum(w / length * q) AS score FROM raw JOIN norm ON raw.idx = norm.idx AND raw.kind = norm.kind JOIN q ON raw.kind = q.kind AND raw.term = q.term GROUP BY raw.idx),
scored AS (SELECT d.idx, coalesce(score, 0) AS score FROM d LEFT JOIN hit ON d.idx = hit.idx)"""


def _match_sql(goal: str) -> str:
    return _scores_sql(goal) + """,
clips AS (SELECT CAST(doc_id AS INT) AS idx, lang AS task, n_chars / 40000.0 AS difficulty FROM documents),
tasks AS (SELECT task, max(score) AS score FROM scored JOIN clips ON scored.idx = clips.idx GROUP BY task),
ranked AS (SELECT task, score, row_number() OVER w AS place, CASE WHEN score > 0 THEN (score - coalesce(lead(score) OVER w, 0)) / score ELSE 0 END AS margin FROM tasks WINDOW w AS (ORDER BY round(score, 9) DESC, task)),
known AS (SELECT r.task, score, place, margin, c.idx, score >= 0.35 AND margin >= 0.2 AS confident FROM ranked r
  JOIN (SELECT task, arg_min(idx, (-difficulty, idx)) AS idx FROM clips GROUP BY task) c ON r.task = c.task WHERE place <= 5 AND score > 0),
none AS (SELECT task, 0.0::DOUBLE AS score, 1 AS place, 0.0::DOUBLE AS margin, idx, false AS confident FROM clips ORDER BY difficulty DESC, idx LIMIT 1)
SELECT task, round(score, 6) AS score, CAST(place AS INT) AS place, round(margin, 6) AS margin, idx, confident, CASE WHEN NOT confident THEN 'weak or ambiguous match' END AS note FROM known
UNION ALL SELECT *, 'nothing matches: the hardest clip is the target' FROM none WHERE NOT EXISTS (FROM known)"""


def doc_clips(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("idx"), F.col("lang").alias("task"), (F.col("n_chars") / 40000.0).alias("difficulty"))


@query("t3_goal_scores", _scores_sql("german text from src7") + " SELECT idx, round(score, 6) AS score FROM scored")
def t3(spark, d):
    return rounded(text.scores(t1(spark, d), "german text from src7"))


@query("t4_goal_match", _match_sql("fr src3"))
def t4(spark, d):
    return rounded(text.match(t1(spark, d), doc_clips(spark, d), "fr src3"))


@query("t4_goal_without_match", _match_sql("qqq 777"))
def t4_none(spark, d):
    return rounded(text.match(t1(spark, d), doc_clips(spark, d), "qqq 777"))


@query("t5_representative", "SELECT lang AS task, arg_min(CAST(doc_id AS INT), (n_chars, doc_id)) AS idx FROM documents GROUP BY lang")
def t5(spark, d):
    return text.representative(doc_clips(spark, d), "easiest")


# ---- orders, selections, ways -----------------------------------------------------------------------------------------


_FARTHEST = "WITH RECURSIVE " + _P.removeprefix("WITH ") + """, first AS (SELECT i AS idx FROM sym GROUP BY i ORDER BY round(sum(d), 6), i LIMIT 1),
near AS (SELECT n.idx, coalesce(s.d, -1) AS gap FROM nodes n, first f LEFT JOIN sym s ON s.i = n.idx AND s.j = f.idx),
walk AS (SELECT 1 AS rank, idx, gap, first_value(idx) OVER (ORDER BY gap DESC, idx) AS nxt FROM near
  UNION ALL SELECT w.rank + 1, w.idx, least(w.gap, coalesce(s.d, -1)), first_value(w.idx) OVER (ORDER BY least(w.gap, coalesce(s.d, -1)) DESC, w.idx)
  FROM walk w LEFT JOIN sym s ON s.i = w.idx AND s.j = w.nxt WHERE w.rank < (SELECT count(*) - 1 FROM nodes))
SELECT idx, 1 AS coreset_rank FROM first UNION ALL SELECT DISTINCT nxt, CAST(rank + 1 AS INT) FROM walk"""


@query("x10_farthest_first", _FARTHEST)
def x10(spark, d):
    write = store.writer(spark)
    return curriculum.coreset_prefix_of(nodes_of(spark, d), None, write)


@query("k8_terrain", _FARTHEST.replace("(SELECT count(*) - 1 FROM nodes)", "27"))
def k8(spark, d):
    write = store.writer(spark)
    return curriculum.coreset_prefix_of(nodes_of(spark, d), 28, write)  # a view of the most different clips


@query("k4_redundant_selection", _P + " SELECT idx FROM (SELECT i AS idx, min(d) AS nn FROM sym GROUP BY i) ORDER BY nn, idx LIMIT 25")
def k4(spark, d):
    return curriculum.select("redundant", 25, None, nodes_of(spark, d), 10**9)


@query("k10_stratified_selection", _P + _W + " SELECT idx FROM (SELECT idx, cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(total, 9), idx) AS turn FROM within) ORDER BY turn, cluster LIMIT 25")
def k10_selection(spark, d):
    return curriculum.select("stratified", 25, None, nodes_of(spark, d), 10**9)


@query("k5_sequential_selection", "SELECT CAST(vec_id AS INT) AS idx FROM embeddings WHERE vec_id < 25")
def k5(spark, d):
    return curriculum.select("sequential", 25, None, nodes_of(spark, d), 10**9)


_COSTS = "WITH RECURSIVE " + (_EDGES + _POOL).removeprefix("WITH ") + """, steps AS (SELECT src, dst, ramp + inter + red + 0.1 AS weight FROM e),
r(idx, cost) USING KEY (idx) AS (SELECT idx, 0.0::DOUBLE AS cost FROM pool
  UNION SELECT s.dst, min(round(r.cost + s.weight, 9)) FROM r JOIN steps s ON s.src = r.idx LEFT JOIN recurring.r AS q ON q.idx = s.dst WHERE q.idx IS NULL OR round(r.cost + s.weight, 9) < q.cost GROUP BY s.dst)"""
_ROUTES = _COSTS + """,
pred AS (SELECT s.dst AS idx, min(s.src) AS prev FROM steps s JOIN r a ON s.src = a.idx JOIN r b ON s.dst = b.idx WHERE round(a.cost + s.weight, 9) = b.cost AND a.cost < b.cost GROUP BY s.dst),
back AS (SELECT idx AS target, idx, 0 AS n FROM r UNION ALL SELECT b.target, p.prev, b.n + 1 FROM back b JOIN pred p ON b.idx = p.idx),
ways AS (SELECT target, CAST(max(n) OVER (PARTITION BY target) - n + 1 AS INT) AS step, idx FROM back)"""


def clip_edges(spark, d, write):
    """The nodes, the scale of their distances, and the written edges of the clip graph with its start."""
    n, cfg = nodes_of(spark, d), GraphConfig()
    scale = graph.scale_of(n, cfg.dtw_quantile, cfg.novelty_quantile)
    heads = graph.start_pool(n).select(F.lit(graph.START).alias("src"), F.col("idx").alias("dst"), F.lit(0.0).alias("weight"))
    return n, scale[0], write(graph.candidate_edges_of(n, cfg, scale).select("src", "dst", "weight").unionByName(heads))


def clip_ways(edges, write):
    tree = write(graph.predecessors(edges, graph.shortest(edges, write)))
    return graph.routes(tree, write)


@query("p1_shortest_costs", _COSTS + " SELECT idx, round(cost, 6) AS cost FROM r")
def p1(spark, d):
    write = store.writer(spark)
    return rounded(graph.shortest(clip_edges(spark, d, write)[2], write).where(F.col("idx") != graph.START))


@query("p1_routes", _ROUTES + " SELECT target, step, ways.idx, round(cost, 6) AS cost FROM ways JOIN r ON ways.idx = r.idx")
def p1_routes(spark, d):
    write = store.writer(spark)
    return rounded(clip_ways(clip_edges(spark, d, write)[2], write))


#: A rehearsal after every second clip, three a way at most.
REHEARSAL = PathConfig(review_every=2, max_reviews=3)


@query("p2_rehearsed_ways", _ROUTES + _W + """,
medoid AS (SELECT arg_min(idx, (round(total, 9), idx)) AS idx FROM within GROUP BY cluster),
way AS (SELECT target, list({'c': w.idx, 'f': n.cluster, 'plain': m.idx IS NULL} ORDER BY step) AS clips FROM ways w JOIN nodes n ON w.idx = n.idx LEFT JOIN medoid m ON m.idx = w.idx GROUP BY target),
far AS (SELECT target, map(list(k), list(dn)) AS far FROM (SELECT DISTINCT a.target, least(a.idx, b.idx) || ':' || greatest(a.idx, b.idx) AS k, dn FROM ways a JOIN ways b ON a.target = b.target AND b.step < a.step AND a.step % 2 = 0 JOIN norm ON i = least(a.idx, b.idx) AND j = greatest(a.idx, b.idx)) GROUP BY target),
fold AS (SELECT way.target, clips, coalesce(far, map([]::VARCHAR[], []::DOUBLE[])) AS far, 0 AS n, []::STRUCT(f INT, m STRUCT(c INT, plain BOOLEAN)[])[] AS fam, []::STRUCT(c INT, review BOOLEAN)[] AS path, 3 AS left_ FROM way LEFT JOIN far ON way.target = far.target
  UNION ALL SELECT target, clips, far, n, list_append(list_filter(fam, lambda g: NOT due OR g.f <> old.f), CASE WHEN due THEN {'f': old.f, 'm': list_extract(list_filter(fam, lambda g: g.f = old.f), 1).m} END).list_filter(lambda g: g IS NOT NULL), CASE WHEN due THEN path || [{'c': x.c, 'review': false}, {'c': again, 'review': true}] ELSE path || [{'c': x.c, 'review': false}] END, left_ - due::INT
  FROM (SELECT *, list_sort(list_transform(old.m, lambda m: {'near': -coalesce(far[least(m.c, x.c) || ':' || greatest(m.c, x.c)], 0), 'plain': m.plain, 'c': m.c}))[1].c AS again,
    list_append(list_filter(was, lambda g: g.f <> x.f), {'f': x.f, 'm': coalesce(list_extract(list_filter(was, lambda g: g.f = x.f), 1).m, []) || [{'c': x.c, 'plain': x.plain}]}) AS fam
    FROM (SELECT target, clips, far, n + 1 AS n, fam AS was, path, left_, clips[n + 1] AS x, fam[1] AS old, left_ > 0 AND n + 1 < len(clips) AND (n + 1) % 2 = 0 AND len(fam) > 0 AS due FROM fold WHERE n < len(clips))))
SELECT target, CAST(s AS INT) AS step, path[s].c AS idx, path[s].review AS is_review FROM (SELECT target, path, unnest(generate_series(1, len(path))) AS s FROM fold WHERE n = len(clips))""")
def p2(spark, d):
    write = store.writer(spark)
    n, scale, edges = clip_edges(spark, d, write)
    measure = lambda p: metrics.with_vectors(p.select(F.col("i").alias("u"), F.col("j").alias("v")), n, scale).select(F.col("u").alias("i"), F.col("v").alias("j"), "dn")
    medoid = P.medoids_of(n).select("idx", F.lit(True).alias("is_cluster_medoid"))
    nodes = write(n.select("idx", "cluster").join(medoid, "idx", "left"))
    return graph.rehearsed(write(clip_ways(edges, write)), nodes, None, REHEARSAL, measure)


_PARTS = _EDGES.replace("r <= 10", "r <= 100") + _POOL.replace("pool AS", "pool_ AS") + """, pool AS (SELECT pool_.idx FROM pool_ JOIN nodes ON pool_.idx = nodes.idx WHERE embodiment = 0), inside AS (SELECT src, dst FROM e WHERE NOT es),
cand AS (SELECT 0 AS tier, 0.0::DOUBLE AS k, src, dst FROM inside UNION ALL SELECT 1, dn, a.idx, b.idx FROM nodes a JOIN nodes b ON a.idx <> b.idx AND a.difficulty <= b.difficulty + 0.05 JOIN norm ON i = least(a.idx, b.idx) AND j = greatest(a.idx, b.idx)),
walk(idx, src, tier) USING KEY (idx) AS (SELECT idx, -1 AS src, -1 AS tier FROM pool
  UNION SELECT * FROM (SELECT dst, src, tier FROM (SELECT c.dst, c.src, c.tier, c.k FROM recurring.walk w JOIN cand c ON c.src = w.idx UNION ALL SELECT idx, -1, 2, difficulty FROM nodes) x WHERE x.dst NOT IN (SELECT idx FROM recurring.walk) AND EXISTS (FROM walk) ORDER BY tier, k, dst, src LIMIT 1))"""


@query("g6_repaired_graph", "WITH RECURSIVE " + _PARTS.removeprefix("WITH ") + """ SELECT src, dst, false AS is_repair FROM inside UNION ALL SELECT -1, idx, false FROM pool UNION ALL SELECT src, idx, true FROM walk WHERE tier > 0""")
def g6(spark, d):
    """A clip graph in three parts: without the edges that change embodiment, and with starts of one. The other two must be reached by repairs."""
    write, n, cfg = store.writer(spark), nodes_of(spark, d), GraphConfig(k_neighbors=100)
    scale = graph.scale_of(n, cfg.dtw_quantile, cfg.novelty_quantile)
    edges = write(graph.candidate_edges_of(n, cfg, scale).where("NOT embodiment_switch"))
    start = graph.start_pool(n).join(n.where("embodiment = 0"), "idx", "left_semi")
    return graph.repair_of(n, edges, start, cfg, write, scale).select("src", "dst", "is_repair")


@query("x5_clusters")
def x5(spark, d):
    """Average-linkage clusters of all items, at the number of clusters with the best silhouette. tests hold the merges against merging one pair at a time."""
    write, n = store.writer(spark), nodes_of(spark, d)
    pairs, items = pairs_of(spark, d), n.count()  # written by merges() alone
    tree = cluster.merges(pairs, "average", write)
    k, _ = cluster.suggest_k(pairs, items, write=write, tree=tree, items=n)
    return cluster.agglomerate(pairs, items, k, write=write, tree=tree).withColumn("k", F.lit(k))


_SIGNED = """WITH m AS (SELECT l_suppkey AS s, s_nationkey AS n, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS x, round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
d AS (SELECT 'nation ' || n AS part, x - y AS d FROM m WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT 'all', x - y FROM m WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT *, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY part, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY part, abs(d)) - 1) / 2.0 END AS r, count(*) OVER (PARTITION BY part, abs(d)) AS c FROM d),
g AS (SELECT part, count(*) AS n, count(*) FILTER (d < 0) AS a_lower, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d > 0) AS a_higher, avg(d) AS mean_difference, coalesce(sum(r) FILTER (d > 0), 0) AS w, sum(CASE WHEN d <> 0 THEN c * c - 1 ELSE 0 END) AS tied FROM r GROUP BY part),
h AS (SELECT *, n - ties AS m, (n - ties) * (n - ties + 1) / 2.0 AS every FROM g), l AS (SELECT *, least(w, every - w) AS low, (every / 2 - least(w, every - w)) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - tied / 48.0) / sqrt(2) AS z FROM h),
p AS (SELECT *, CASE WHEN ties = 0 AND tied = 0 AND m <= 50 THEN 2 * list_sum(list_reduce(range(1, m + 1), lambda ways, k: list_transform(ways, lambda x, s: x + CASE WHEN s > k THEN ways[s - k] ELSE 0 END), [1.0::DOUBLE] || list_transform(range(1, CAST(least(every, 1275) AS INT) + 1), lambda s: 0.0::DOUBLE))[:CAST(low AS INT) + 1]) / pow(2, m)
  WHEN z <= 0 THEN 1 WHEN z < 3 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 61), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(z, 2 * k + 1) / gamma(k + 1.0::DOUBLE) / (2 * k + 1)))
  ELSE exp(-z * z) / sqrt(pi()) / list_reduce(range(60, 0, -1), lambda a, k: z + k / 2.0 / a, z) END AS p FROM l)
SELECT part, n, a_lower, ties, a_higher, round(mean_difference, 6) AS mean_difference, round(least(p, 1), 6) AS p_value FROM p"""


@query("x14_signed_rank", _SIGNED)
def x14(spark, d):
    """Whether suppliers' returned lines cost less than those not returned: paired by supplier, by nation and over all."""
    li = T.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice")
    mean = lambda flag: F.round(F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))), 2)
    by = li.groupBy("l_suppkey").agg(mean("R").alias("x"), mean("N").alias("y")).join(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    parts = by.select(F.explode(F.array(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.lit("all"))).alias("part"), "x", "y")
    return rounded(signed_rank(parts, ["part"], "x", "y"))
