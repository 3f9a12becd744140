"""Registered queries: norm stats, chunks, vectors (build-plan steps 1–2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions import vectors as V
from epiframe.operators import stats as S
from epiframe.operators import windows as W
from epiframe.plans.catalog import query
from epiframe.plans.sqlviews import FRAMES_EV, FRAMES_LI, r6, stats_sql
from epiframe.session import r6 as R6
from epiframe.sources import views

STATS_COLS = ["key", "dim", "count", "mean", "std", "min", "max", "q01", "q99"]


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: R6(F.col(c)) for c in cols})


def stats_out(st: DataFrame) -> DataFrame:
    return rounded(st, ["mean", "std", "min", "max", "q01", "q99"]).select(*STATS_COLS)


def explode_chunk(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys…, i, dim, value) rows of a chunk column."""
    e = df.select(*keys, F.posexplode(col).alias("i", "_row"))
    return e.select(*keys, F.col("i").cast("bigint").alias("i"),
                    F.posexplode("_row").alias("dim", "value")).withColumn("dim", F.col("dim").cast("bigint"))


# ---------------------------------------------------------------- A4 flagship
FLAGSHIP_H = 4
FLAGSHIP_MASK = [True, False]


def flagship(spark, sf_dir: str) -> DataFrame:
    frames = views.frames_ev(spark, sf_dir)
    return stats_out(S.norm_stats_pipeline(frames, FLAGSHIP_H, FLAGSHIP_MASK))


query("norm_stats_pipeline", f"""
WITH {FRAMES_EV},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
pairs AS (
  SELECT episode_id, t, st0, least(t + i, last_t) AS j FROM (
    SELECT f.episode_id, f.t, f.s0 AS st0, len.last_t, unnest(range(0, {FLAGSHIP_H})) AS i
    FROM frames_ev f JOIN len ON f.episode_id = len.episode_id)),
vals AS (
  SELECT 'state' AS key, 0 AS dim, s0 AS x FROM frames_ev
  UNION ALL SELECT 'state', 1, s1 FROM frames_ev
  UNION ALL SELECT 'actions', 0, a.s0 - p.st0 FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j
  UNION ALL SELECT 'actions', 1, a.s1 FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j),
{stats_sql()}
SELECT * FROM stats_out""")(flagship)


# ---------------------------------------------------------------- A1 / A2 / A3 on lineitem frames
LI_VALS = """vals AS (
  SELECT 'state' AS key, 0 AS dim, s0 AS x FROM frames_li UNION ALL SELECT 'state', 1, s1 FROM frames_li
  UNION ALL SELECT 'state', 2, s2 FROM frames_li UNION ALL SELECT 'state', 3, s3 FROM frames_li)"""


@query("norm_stats_moments", f"""
WITH {FRAMES_LI}, {LI_VALS}
SELECT key, CAST(dim AS BIGINT) AS dim, count(x) AS count, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std
FROM vals GROUP BY key, dim""")
def q_moments(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    m = S.moments(S.long_values(li, vector_cols=["state"]))
    return rounded(m, ["mean", "std"]).select("key", "dim", "count", "mean", "std")


@query("norm_stats_minmax", f"""
WITH {FRAMES_LI}, {LI_VALS}
SELECT key, CAST(dim AS BIGINT) AS dim, {r6('min(x)')} AS min, {r6('max(x)')} AS max FROM vals GROUP BY key, dim""")
def q_minmax(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    m = S.moments(S.long_values(li, vector_cols=["state"]))
    return rounded(m, ["min", "max"]).select("key", "dim", "min", "max")


@query("norm_stats_quantile", f"""
WITH vals AS (
  SELECT 'embedding' AS key, CAST(d.i - 1 AS BIGINT) AS dim, CAST(embedding[d.i] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) d),
{stats_sql()}
SELECT key, dim, q01, q99 FROM stats_out""")
def q_quantile(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumnRenamed("state", "embedding")
    st = S.norm_stats(S.long_values(v, vector_cols=["embedding"]))
    return rounded(st, ["q01", "q99"]).select("key", "dim", "q01", "q99")


# ---------------------------------------------------------------- W1 chunk
@query("action_chunk", f"""
WITH {FRAMES_EV},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
pairs AS (
  SELECT episode_id, t, i, least(t + i, last_t) AS j FROM (
    SELECT f.episode_id, f.t, len.last_t, unnest(range(0, 4)) AS i
    FROM frames_ev f JOIN len ON f.episode_id = len.episode_id))
SELECT p.episode_id, p.t, CAST(p.i AS BIGINT) AS i, CAST(0 AS BIGINT) AS dim, {r6('a.s0')} AS value
FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j
UNION ALL
SELECT p.episode_id, p.t, CAST(p.i AS BIGINT), CAST(1 AS BIGINT), {r6('a.s1')}
FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j""")
def q_action_chunk(spark, sf_dir):
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "actions")
    ch = W.action_chunk(f, 4)
    return explode_chunk(ch, "actions", ["episode_id", "t"]).withColumn("value", R6("value"))


# ---------------------------------------------------------------- weights without chunks (trap 15)
@query("chunk_weighted_stats", f"""
WITH {FRAMES_EV},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
pairs AS (
  SELECT episode_id, least(t + i, last_t) AS j FROM (
    SELECT f.episode_id, f.t, len.last_t, unnest(range(0, 8)) AS i
    FROM frames_ev f JOIN len ON f.episode_id = len.episode_id)),
vals AS (
  SELECT 'actions' AS key, 0 AS dim, a.s0 AS x FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j
  UNION ALL SELECT 'actions', 1, a.s1 FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j)
SELECT key, CAST(dim AS BIGINT) AS dim, count(*) AS count, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std
FROM vals GROUP BY key, dim""")
def q_chunk_weighted(spark, sf_dir):
    f = views.frames_ev(spark, sf_dir)
    wv = S.weighted_values(f, 8).filter(F.col("key") == "actions")
    m = S.weighted_moments(wv)
    return rounded(m, ["mean", "std"]).select("key", "dim", "count", "mean", "std")


# ---------------------------------------------------------------- M1–M4 normalise / inverse
def _li_stats(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    return li, S.norm_stats(S.long_values(li, vector_cols=["state"]))


QB_EDGE = "qb.{b} * ((r.hi - r.lo) / CAST(5000 AS DOUBLE)) + r.lo"
LI_STATS_SQL = f"""{FRAMES_LI}, {LI_VALS}, {stats_sql()},
raw AS (
  SELECT m.key, m.dim, m.mean, m.std, {QB_EDGE.format(b="b01")} AS q01, {QB_EDGE.format(b="b99")} AS q99
  FROM m JOIN r ON m.key = r.key AND m.dim = r.dim JOIN qb ON m.key = qb.key AND m.dim = qb.dim)"""


def _norm_sql(expr_by_dim: str) -> str:
    return f"""
WITH {LI_STATS_SQL},
fl AS (SELECT episode_id, t, 0 AS dim, s0 AS x FROM frames_li UNION ALL SELECT episode_id, t, 1, s1 FROM frames_li
       UNION ALL SELECT episode_id, t, 2, s2 FROM frames_li UNION ALL SELECT episode_id, t, 3, s3 FROM frames_li)
SELECT fl.episode_id, fl.t, CAST(fl.dim AS BIGINT) AS dim, {r6(expr_by_dim)} AS value
FROM fl JOIN raw ON raw.dim = fl.dim AND raw.key = 'state'"""


def _long_vec(df: DataFrame, col: str) -> DataFrame:
    return df.select("episode_id", "t", F.posexplode(V.listed(col)).alias("dim", "value")).select(
        "episode_id", "t", F.col("dim").cast("bigint"), R6("value").alias("value"))


@query("normalize_z", _norm_sql("(fl.x - raw.mean) / (raw.std + CAST('1e-6' AS DOUBLE))"))
def q_normalize_z(spark, sf_dir):
    li, st = _li_stats(spark, sf_dir)
    return _long_vec(S.apply_stats(li, st, {"state": "state"}, mode="z"), "state")


@query("normalize_q", _norm_sql(
    "(fl.x - raw.q01) / (raw.q99 - raw.q01 + CAST('1e-6' AS DOUBLE)) * CAST(2 AS DOUBLE) - CAST(1 AS DOUBLE)"))
def q_normalize_q(spark, sf_dir):
    li, st = _li_stats(spark, sf_dir)
    return _long_vec(S.apply_stats(li, st, {"state": "state"}, mode="quantile"), "state")


ZN = "((fl.x - raw.mean) / (raw.std + CAST('1e-6' AS DOUBLE)))"
QN = ("((fl.x - raw.q01) / (raw.q99 - raw.q01 + CAST('1e-6' AS DOUBLE)) * CAST(2 AS DOUBLE) - CAST(1 AS DOUBLE))")


@query("unnormalize_z", _norm_sql(f"{ZN} * (raw.std + CAST('1e-6' AS DOUBLE)) + raw.mean"))
def q_unnormalize_z(spark, sf_dir):
    """Inverse after forward: z-normalise then un-normalise (≈ identity)."""
    li, st = _li_stats(spark, sf_dir)
    fwd = S.apply_stats(li, st, {"state": "state"}, mode="z")
    return _long_vec(S.apply_stats(fwd, st, {"state": "state"}, mode="z", inverse=True), "state")


@query("unnormalize_q", _norm_sql(
    f"({QN} + CAST(1 AS DOUBLE)) / CAST(2 AS DOUBLE) * (raw.q99 - raw.q01 + CAST('1e-6' AS DOUBLE)) + raw.q01"))
def q_unnormalize_q(spark, sf_dir):
    """Inverse after forward in quantile mode (≈ identity inside the stats' dims)."""
    li, st = _li_stats(spark, sf_dir)
    fwd = S.apply_stats(li, st, {"state": "state"}, mode="quantile")
    return _long_vec(S.apply_stats(fwd, st, {"state": "state"}, mode="quantile", inverse=True), "state")


# ---------------------------------------------------------------- A4 on the larger frame view
LI_H = 10
LI_MASK = [True, False, False, False]


@query("norm_stats_pipeline_li", f"""
WITH {FRAMES_LI},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_li GROUP BY episode_id),
pairs AS (
  SELECT episode_id, t, st0, least(t + i, last_t) AS j FROM (
    SELECT f.episode_id, f.t, f.s0 AS st0, len.last_t, unnest(range(0, {LI_H})) AS i
    FROM frames_li f JOIN len ON f.episode_id = len.episode_id)),
ch AS (SELECT p.st0, a.s0, a.s1, a.s2, a.s3 FROM pairs p JOIN frames_li a ON a.episode_id = p.episode_id AND a.t = p.j),
vals AS (
  SELECT 'state' AS key, 0 AS dim, s0 AS x FROM frames_li UNION ALL SELECT 'state', 1, s1 FROM frames_li
  UNION ALL SELECT 'state', 2, s2 FROM frames_li UNION ALL SELECT 'state', 3, s3 FROM frames_li
  UNION ALL SELECT 'actions', 0, s0 - st0 FROM ch UNION ALL SELECT 'actions', 1, s1 FROM ch
  UNION ALL SELECT 'actions', 2, s2 FROM ch UNION ALL SELECT 'actions', 3, s3 FROM ch),
{stats_sql()}
SELECT * FROM stats_out""")
def q_norm_stats_li(spark, sf_dir):
    """A4 over lineitem episodes: 10-step chunks, delta on the first dim, stats of state and actions."""
    frames = views.frames_li(spark, sf_dir)
    return stats_out(S.norm_stats_pipeline(frames, LI_H, LI_MASK))


