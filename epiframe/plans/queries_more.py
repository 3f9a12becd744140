"""Registered queries: joins, sampling/batching, evaluation, text features (steps 6–7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import text as TX
from epiframe.functions import vectors as V
from epiframe.functions.hashing import hash_key_sql, unit_hash_sql
from epiframe.operators import evaluation as EV
from epiframe.operators import joins as J
from epiframe.operators import sampling as SM
from epiframe.operators import windows as W
from epiframe.plans.catalog import query
from epiframe.plans.ordered import index_within
from epiframe.plans.sqlviews import FRAMES_EV, FRAMES_LI, LOG_LINES, r6
from epiframe.session import join_small
from epiframe.session import r6 as R6
from epiframe.sources import views


def d(v) -> str:
    return f"CAST('{v}' AS DOUBLE)"


# ---------------------------------------------------------------- J1 / J4 / J10 / J11 / J12
@query("join_task_prompt", """
SELECT e.vec_id, e.label AS task_index, n.n_name AS prompt FROM embeddings e JOIN nation n ON n.n_nationkey = e.label""")
def q_join_task_prompt(spark, sf_dir):
    v = views.vectors(spark, sf_dir).select("vec_id", "task_index")
    tasks = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task_index"),
                                                       F.col("n_name").alias("task"))
    return J.join_task_prompt(v, tasks)


@query("join_annotation", """
SELECT u.user_id AS episode_id, COALESCE(r.r_name, 'Do something') AS instruction
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN region r ON r.r_regionkey = u.user_id""")
def q_join_annotation(spark, sf_dir):
    eps = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id")).distinct()
    ann = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("episode_id"),
                                                     F.col("r_name").alias("instruction"))
    return J.join_annotation(eps, ann)


def _pair_sql(a: int, b: int) -> str:
    diff = f"abs(CAST(embedding[i + {a * 16}] AS DOUBLE) - CAST(embedding[i + {b * 16}] AS DOUBLE))"
    same = f"bool_and(CAST(embedding[i + {a * 16}] AS DOUBLE) = CAST(embedding[i + {b * 16}] AS DOUBLE))"
    return f"{same} AS v{a}__v{b}__same, {r6(f'sum({diff}) / CAST(16 AS DOUBLE)')} AS v{a}__v{b}__mad"


@query("view_pairs", f"""
SELECT vec_id, {', '.join(_pair_sql(a, b) for a in range(4) for b in range(a + 1, 4))}
FROM embeddings, (SELECT unnest(range(1, 17)) AS i) GROUP BY vec_id""")
def q_view_pairs(spark, sf_dir):
    v = views.vectors(spark, sf_dir).select("vec_id", *[F.slice("state", 1 + 16 * k, 16).alias(f"v{k}") for k in range(4)])
    out = J.view_pairs(v, ["v0", "v1", "v2", "v3"])
    mads = [c for c in out.columns if c.endswith("__mad")]
    return out.drop("v0", "v1", "v2", "v3").withColumns({c: R6(c) for c in mads})


KEYED_SQL = f"""ref AS (
  SELECT 'nation/' || n_name AS key, CAST(n_regionkey AS DOUBLE) AS value, 'int' AS dtype FROM nation
  UNION ALL SELECT 'region/' || r_name, CAST(r_regionkey AS DOUBLE), 'float' FROM region),
loaded AS (SELECT 'nation/NATION_' || CAST(s_suppkey AS VARCHAR) AS key, s_acctbal AS value FROM supplier)"""


@query("keyed_merge", f"""WITH {KEYED_SQL}
SELECT l.key, {r6('CAST(trunc(l.value) AS DOUBLE)')} AS value, 'int' AS dtype, 'loaded' AS origin
FROM loaded l JOIN ref r ON l.key = r.key
UNION ALL
SELECT r.key, {r6('r.value')}, r.dtype, 'reference' FROM ref r
WHERE r.key NOT IN (SELECT key FROM loaded) AND regexp_full_match(r.key, 'region/.*')""")
def q_keyed_merge(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    r = views.table(spark, sf_dir, "region")
    ref = n.select(F.concat(F.lit("nation/"), "n_name").alias("key"), F.col("n_regionkey").cast("double").alias("value"),
                   F.lit("int").alias("dtype")).unionByName(
        r.select(F.concat(F.lit("region/"), "r_name").alias("key"), F.col("r_regionkey").cast("double").alias("value"),
                 F.lit("float").alias("dtype")))
    s = views.table(spark, sf_dir, "supplier")
    loaded = s.select(F.concat(F.lit("nation/NATION_"), F.col("s_suppkey").cast("string")).alias("key"),
                      F.col("s_acctbal").alias("value"))
    return J.keyed_merge(loaded, ref, "region/.*").withColumn("value", R6("value"))


@query("stats_catalogue", """
WITH e AS (SELECT vec_id, label AS asset_id, unnest(range(0, 64)) AS dim, unnest(embedding) AS x FROM embeddings),
cat AS (SELECT asset_id, dim, avg(CAST(x AS DOUBLE)) AS mean FROM e GROUP BY asset_id, dim)
SELECT e.vec_id, e.asset_id, e.dim, floor(c.mean * 1000000 + CAST('0.49997' AS DOUBLE)) / 1000000 AS mean
FROM e JOIN cat c ON c.asset_id = e.asset_id AND c.dim = e.dim""")
def q_stats_catalogue(spark, sf_dir):
    v = views.vectors(spark, sf_dir).select("vec_id", F.col("task_index").alias("asset_id"), "state")
    each = v.select("asset_id", F.posexplode("state").alias("dim", "x"))
    means = each.groupBy("asset_id", "dim").agg(F.avg("x").alias("m"))
    cat = means.groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    out = J.stats_catalogue(v.select("vec_id", "asset_id"), cat)
    return out.select("vec_id", "asset_id", F.posexplode("stats.mean").alias("dim", "mean")).select(
        "vec_id", "asset_id", F.col("dim").cast("bigint").alias("dim"), R6("mean").alias("mean"))


# ---------------------------------------------------------------- T2 / T4 / T5 / T6 / T7 / T8 / P13 / T3
SHUF_SQL = f"""sh AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY {hash_key_sql(['vec_id', '0'], 7)}, vec_id) - 1 AS BIGINT) AS pos
                FROM embeddings),
cnt AS (SELECT count(*) AS n FROM embeddings)"""


def _shuffled(spark, sf_dir):
    v = views.vectors(spark, sf_dir).select("vec_id")
    return SM.shuffle_order(v, ["vec_id"], seed=7, epoch=0)


@query("shuffle_hash", f"WITH {SHUF_SQL} SELECT vec_id, pos FROM sh")
def q_shuffle_hash(spark, sf_dir):
    return _shuffled(spark, sf_dir)


@query("batch_rows", f"""WITH {SHUF_SQL}
SELECT vec_id, pos, CAST(pos // 32 AS BIGINT) AS batch FROM sh, cnt WHERE pos < (n // 32) * 32""")
def q_batch_rows(spark, sf_dir):
    return SM.batch_rows(_shuffled(spark, sf_dir), 32, rows=views.table(spark, sf_dir, "embeddings"))


@query("epoch_loop", f"""WITH {SHUF_SQL},
u AS (SELECT (n // 32) * 32 AS usable FROM cnt),
slots AS (SELECT s.slot, s.slot // u.usable AS epoch, s.slot % u.usable AS pos
          FROM u, (SELECT unnest(range(0, (SELECT (2 * (n // 32) + 1) * 32 FROM cnt))) AS slot) s)
SELECT CAST(slots.slot AS BIGINT) AS slot, CAST(epoch AS BIGINT) AS epoch, sh.vec_id, CAST(slots.slot // 32 AS BIGINT) AS batch
FROM slots JOIN sh ON sh.pos = slots.pos""")
def q_epoch_loop(spark, sf_dir):
    """T5: 2 epochs + 1 batch of 32, wrapping over the shuffled table."""
    out = SM.epoch_loop(_shuffled(spark, sf_dir), 32, epochs=2, rows=views.table(spark, sf_dir, "embeddings"))
    return out.select("slot", "epoch", "vec_id", "batch")


@query("rank_split", f"""WITH {SHUF_SQL}
SELECT vec_id, pos FROM sh, cnt WHERE pos < (n // 3) * 3 AND pos % 3 = 1""")
def q_rank_split(spark, sf_dir):
    return SM.rank_split(_shuffled(spark, sf_dir), 3, 1, rows=views.table(spark, sf_dir, "embeddings"))


@query("sample_k", f"""
SELECT vec_id FROM embeddings ORDER BY {hash_key_sql(['vec_id'], 11)}, vec_id LIMIT 50""")
def q_sample_k(spark, sf_dir):
    """50 without replacement (the limit is the feature), then sorted."""
    return SM.sample_k(views.vectors(spark, sf_dir).select("vec_id"), ["vec_id"], 50, seed=11)


@query("sample_k_per_episode", f"""WITH {FRAMES_EV},
r AS (SELECT episode_id, t, row_number() OVER (PARTITION BY episode_id ORDER BY {hash_key_sql(['episode_id', 't'], 5)}, t) AS rn
      FROM frames_ev)
SELECT episode_id, t FROM r WHERE rn <= 7""")
def q_sample_k_per_episode(spark, sf_dir):
    """k=5 with the x1.5 over-draw → 7 per episode."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t")
    return SM.sample_k_per_episode(f, 5, seed=5, overdraw=1.5)


@query("sample_k_filtered", f"""WITH {FRAMES_EV},
r AS (SELECT episode_id, t, s1, row_number() OVER (PARTITION BY episode_id ORDER BY {hash_key_sql(['episode_id', 't'], 5)}, t) AS rn FROM frames_ev),
p AS (SELECT episode_id, t, row_number() OVER (PARTITION BY episode_id ORDER BY rn) AS kept FROM r WHERE rn <= 12 AND s1 >= 30)
SELECT episode_id, t FROM p WHERE kept <= 5""")
def q_sample_k_filtered(spark, sf_dir):
    """12 frames drawn per episode, those of a low second dim left out, the first 5 of the rest."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "state")
    return SM.sample_k_per_episode(f, 5, seed=5, overdraw=2.4, keep=F.col("state")[1] >= 30).select("episode_id", "t")


def _feistel_sql(n: str, keys: list[int], index: str) -> str:
    """One pass of the rounds over ``index`` with digits of base ceil(sqrt(n))."""
    a = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"
    m1, m2 = SM._MULTIPLY

    def spread(x: str, key: int) -> str:
        h = f"({x} * {m1} + {key})"
        h = f"((xor({h}, {h} >> 17) & 2147483647) * {m2})"
        return f"(xor({h}, {h} >> 15) & 2147483647)"

    sql = f"SELECT *, {index} % {a} AS l0, {index} // {a} AS r0 FROM src"
    for i, key in enumerate(keys):
        sql = f"SELECT *, r{i} AS l{i + 1}, (l{i} + {spread(f'r{i}', key)}) % {a} AS r{i + 1} FROM ({sql})"
    return f"SELECT id, n, r{len(keys)} * {a} + l{len(keys)} AS x FROM ({sql})"


_WALK = _feistel_sql("n", SM.round_keys(9, 0), "x")


@query("shuffle_dense", f"""WITH RECURSIVE cnt AS (SELECT count(*) AS n FROM embeddings),
start AS (SELECT vec_id AS id, n, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS x FROM embeddings, cnt),
walk AS (SELECT * FROM ({_WALK.replace('FROM src', 'FROM start src')})
         UNION ALL SELECT * FROM ({_WALK.replace('FROM src', 'FROM (SELECT id, n, x FROM walk WHERE x >= n) src')}))
SELECT id AS vec_id, x AS pos FROM walk WHERE x < n""")
def q_shuffle_dense(spark, sf_dir):
    """Shuffled places of a dense index by a keyed permutation."""
    v = index_within(views.table(spark, sf_dir, "embeddings").select("vec_id"), [], ["vec_id"], out="idx")
    return SM.shuffle_dense(v, "idx", views.table(spark, sf_dir, "embeddings"), seed=9).select("vec_id", "pos")


@query("choose_instruction", f"""WITH c AS (
  SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS a, max(CASE WHEN role = 'assistant' THEN turn END) AS b,
         max(turn) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, [a, b, c][CAST({hash_key_sql(['conv_id', '0'], 3)} % 3 AS INTEGER) + 1] AS chosen FROM c""")
def q_choose_instruction(spark, sf_dir):
    """One of three per-episode options, same for the whole episode (epoch 0)."""
    c = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("a"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("b"), F.max("turn").alias("c"))
    return c.select("conv_id", SM.choose_per_episode(["a", "b", "c"], "conv_id", seed=3, epoch=0).alias("chosen"))


@query("weighted_mix", f"""WITH
rows AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS source, doc_id,
                row_number() OVER (PARTITION BY CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END ORDER BY doc_id) - 1 AS rw
         FROM documents),
sizes AS (SELECT source, count(*) AS size FROM rows GROUP BY source),
slots AS (SELECT slot, CASE WHEN {unit_hash_sql(['slot'], 9)} < CAST(0.9 AS DOUBLE) THEN 'en' ELSE 'other' END AS source
          FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS slot)),
ks AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM slots)
SELECT CAST(ks.slot AS BIGINT) AS slot, ks.source, rows.doc_id
FROM ks JOIN sizes ON ks.source = sizes.source JOIN rows ON rows.source = ks.source AND rows.rw = ks.k % sizes.size""")
def q_weighted_mix(spark, sf_dir):
    """0.9 English / 0.1 other documents, as many slots as documents; small source repeats."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = docs.count()
    out = SM.weighted_mix(spark, {"en": docs.filter(F.col("lang") == "en").select("doc_id"),
                                  "other": docs.filter(F.col("lang") != "en").select("doc_id")},
                          {"en": 0.9, "other": 0.1}, n, ["doc_id"], seed=9)
    return out.select(F.col("slot").cast("bigint"), "source", "doc_id")


@query("union_datasets", f"""WITH {FRAMES_EV}, {FRAMES_LI}
SELECT episode_id, t, task, 'events' AS dataset FROM frames_ev
UNION ALL SELECT episode_id, t, task, 'lineitem' FROM frames_li""")
def q_union_datasets(spark, sf_dir):
    ev = views.frames_ev(spark, sf_dir).select("episode_id", "t", "task")
    li = views.frames_li(spark, sf_dir).select("episode_id", "t", "task")
    return SM.union_datasets({"events": ev, "lineitem": li})


@query("retain_versions", """
WITH m AS (SELECT o_custkey, max(o_orderkey) AS mx FROM orders GROUP BY o_custkey)
SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN m ON o.o_custkey = m.o_custkey
WHERE o.o_orderkey = m.mx OR o.o_orderkey % 50 = 0""")
def q_retain_versions(spark, sf_dir):
    """Per customer keep the newest order plus every 50th (keep_period)."""
    o = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return SM.retain_versions(o, ["o_custkey"], "o_orderkey", 50)


@query("latest_version", f"""
SELECT o_custkey, max(o_orderkey) AS o_orderkey, {r6('arg_max(o_totalprice, o_orderkey)')} AS o_totalprice
FROM orders GROUP BY o_custkey""")
def q_latest_version(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return SM.latest_version(o, ["o_custkey"], "o_orderkey", "o_totalprice").withColumn("o_totalprice", R6("o_totalprice"))


@query("next_seq", """SELECT conv_id, COALESCE(max(turn), -1) + 1 AS next_seq FROM conversations GROUP BY conv_id""")
def q_next_seq(spark, sf_dir):
    return SM.next_seq(views.table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


# ---------------------------------------------------------------- A5 / J8 / W5 evaluation
EVAL_SQL = f"""{FRAMES_EV},
pr AS (SELECT episode_id, t, s0 * {d(1.01)} + {d(0.5)} AS p0, s1 * {d(1.01)} + {d(0.5)} AS p1,
              lead(s0) OVER (PARTITION BY episode_id ORDER BY t) AS n0,
              lead(s1) OVER (PARTITION BY episode_id ORDER BY t) AS n1 FROM frames_ev),
smp AS (SELECT episode_id, t, (abs(p0 - n0) + abs(p1 - n1)) / {d(2)} AS l1,
               sqrt(((p0 - n0) * (p0 - n0) + (p1 - n1) * (p1 - n1)) / {d(2)}) AS l2, p0, p1, n0, n1
        FROM pr WHERE n0 IS NOT NULL)"""


def _eval_pairs(spark, sf_dir):
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "state")
    f = f.withColumn("pred", F.transform("state", lambda x: x * F.lit(1.01) + F.lit(0.5)))
    return EV.eval_pairs(f, ["state"])


@query("eval_pairs", f"""WITH {EVAL_SQL}
SELECT episode_id, t, {r6('n0')} AS next0, {r6('n1')} AS next1 FROM smp""")
def q_eval_pairs(spark, sf_dir):
    p = _eval_pairs(spark, sf_dir)
    return p.select("episode_id", "t", R6(F.col("next_state")[0]).alias("next0"), R6(F.col("next_state")[1]).alias("next1"))


@query("eval_summary", f"""WITH {EVAL_SQL}
SELECT count(*) AS n, {r6('avg(l1)')} AS l1_mean, {r6('stddev_pop(l1)')} AS l1_std, {r6('quantile_cont(l1, 0.5)')} AS l1_median,
       {r6('max(l1)')} AS l1_max, {r6('avg(l2)')} AS l2_mean, {r6('stddev_pop(l2)')} AS l2_std,
       {r6('quantile_cont(l2, 0.5)')} AS l2_median, {r6('max(l2)')} AS l2_max FROM smp""")
def q_eval_summary(spark, sf_dir):
    s = EV.eval_summary(EV.eval_samples(_eval_pairs(spark, sf_dir), "pred", "next_state"))
    return s.select("n", *[R6(c).alias(c) for c in s.columns if c != "n"])


@query("eval_per_dim", f"""WITH {EVAL_SQL}
SELECT CAST(0 AS BIGINT) AS dim, {r6('avg(abs(p0 - n0))')} AS mean_abs_err, 'value' AS label FROM smp
UNION ALL SELECT CAST(1 AS BIGINT), {r6('avg(abs(p1 - n1))')}, 'k' FROM smp""")
def q_eval_per_dim(spark, sf_dir):
    e = EV.eval_per_dim(_eval_pairs(spark, sf_dir), "pred", "next_state", ["value", "k"])
    return e.withColumn("mean_abs_err", R6("mean_abs_err"))


# ---------------------------------------------------------------- A6 / A7 / A10 / A14 / A15
@query("latency_summary", f"""
SELECT event_type AS metric, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std,
  {r6('quantile_cont(value, 0.25)')} AS p25, {r6('quantile_cont(value, 0.5)')} AS p50, {r6('quantile_cont(value, 0.75)')} AS p75,
  {r6('quantile_cont(value, 0.9)')} AS p90, {r6('quantile_cont(value, 0.95)')} AS p95, {r6('quantile_cont(value, 0.99)')} AS p99
FROM events GROUP BY event_type""")
def q_latency_summary(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("value").alias("ms"))
    s = EV.latency_summary(ev)
    return s.select("metric", *[R6(c).alias(c) for c in s.columns if c != "metric"])


@query("success_rollup", f"""
SELECT event_type AS task, {r6('avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)')} AS rate, count(*) AS n,
       CAST(grouping(event_type) AS BIGINT) AS level
FROM events GROUP BY ROLLUP (event_type)""")
def q_success_rollup(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("task"),
                                                    (F.col("value") > 50).alias("success"))
    r = EV.success_rollup(ev)
    return r.select("task", R6("rate").alias("rate"), "n", F.col("level").cast("bigint"))


@query("frame_qa", f"""WITH px AS (
  SELECT vec_id, label, (i - 1) // 16 AS k, i, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
per AS (SELECT vec_id, any_value(label) AS label, k, min(x) AS mn, max(x) AS mx, list(x ORDER BY i) AS v FROM px GROUP BY vec_id, k),
f AS (SELECT *, EXISTS (SELECT 1 FROM per e WHERE e.vec_id = per.vec_id AND e.k < per.k AND e.v = per.v) AS twin FROM per)
SELECT 'v' || CAST(k AS VARCHAR) AS view, count(*) AS n, count(*) FILTER (WHERE mn = mx) AS n_constant, CAST(0 AS BIGINT) AS n_bad_size,
       count(*) FILTER (WHERE twin) AS n_same, count(*) FILTER (WHERE k = 3 AND label % 5 = 0) AS n_masked,
       {r6('min(mn)')} AS min, {r6('max(mx)')} AS max, {r6('(SELECT stddev_pop(x) FROM px WHERE px.k = f.k)')} AS std,
       count(*) FILTER (WHERE mn = mx OR twin OR (k = 3 AND label % 5 = 0)) = 0 AS ok
FROM f GROUP BY k""")
def q_frame_qa(spark, sf_dir):
    """A10 over four 16-dim views; the last is masked out where the label is a multiple of 5."""
    v = views.vectors(spark, sf_dir).select(*[F.slice("state", 1 + 16 * k, 16).alias(f"v{k}") for k in range(4)],
                                            *[(F.lit(k != 3) | (F.col("task_index") % 5 != 0)).alias(f"m{k}") for k in range(4)])
    q = EV.frame_qa(v, [f"v{k}" for k in range(4)], [16], [f"m{k}" for k in range(4)])
    return q.select("view", "n", "n_constant", "n_bad_size", "n_same", "n_masked", *[R6(c).alias(c) for c in ("min", "max", "std")], "ok")


@query("rollout_summary", f"""
SELECT count(*) FILTER (WHERE value / {d(400)} BETWEEN 0 AND 1) AS n_valid,
       count(*) FILTER (WHERE NOT (value / {d(400)} BETWEEN 0 AND 1)) AS n_invalid,
       {r6(f'avg(CASE WHEN value / {d(400)} BETWEEN 0 AND 1 THEN value / {d(400)} END)')} AS mean_success,
       {r6(f'avg(CASE WHEN value / {d(400)} BETWEEN 0 AND 1 THEN user_id END)')} AS mean_duration FROM events""")
def q_rollout_summary(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select((F.col("value") / F.lit(400.0)).alias("success"),
                                                    F.col("user_id").alias("duration"))
    r = EV.rollout_summary(ev)
    return r.select("n_valid", "n_invalid", R6("mean_success").alias("mean_success"), R6("mean_duration").alias("mean_duration"))


RATE_SQL = """rt AS (
  SELECT event_id, event_type, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS tsec,
         count(*) OVER w AS n, max(epoch_us(ts) / CAST(1000000 AS DOUBLE)) OVER w - min(epoch_us(ts) / CAST(1000000 AS DOUBLE)) OVER w AS span
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query("rate_last50", f"""WITH {RATE_SQL}
SELECT event_id, COALESCE({r6('CASE WHEN n > 1 AND span > 0 THEN (n - 1) / span END')}, CAST(-1 AS DOUBLE)) AS rate FROM rt""")
def q_rate_last50(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("channel"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), F.col("ts").alias("_ts"))
    ev = index_within(ev, ["channel"], ["_ts", "event_id"], out="seq")
    r = EV.rate_last50(ev, "channel", "ts", "seq")
    return r.select("event_id", F.coalesce(R6("rate"), F.lit(-1.0)).alias("rate"))


@query("newest_only", """
WITH e AS (SELECT event_id, event_type, ts,
                  max(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
           FROM events)
SELECT event_id FROM e WHERE prev IS NULL OR ts > prev""")
def q_newest_only(spark, sf_dir):
    """channel = event type; readings arrive user by user (arrival = user_id, event_id)."""
    ev = views.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("channel"), "ts")
    return W.newest_only(ev, "channel", ["user_id", "event_id"], "ts").select("event_id")


# ---------------------------------------------------------------- J9 / W6 replay
REPLAY_SQL = f"""{FRAMES_EV},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id)"""


@query("chunk_replay", f"""WITH {REPLAY_SQL}
SELECT f.episode_id, f.t, CAST(f.t // 4 AS BIGINT) AS block, CAST(f.t % 4 AS BIGINT) AS "offset", CAST(d.dim AS BIGINT) AS dim,
       CASE d.dim WHEN 0 THEN {r6('a.s0')} ELSE {r6('a.s1')} END AS action
FROM frames_ev f JOIN len ON f.episode_id = len.episode_id
JOIN frames_ev a ON a.episode_id = f.episode_id AND a.t = least((f.t // 4) * 4 + f.t % 4, len.last_t), (VALUES (0), (1)) d(dim)""")
def q_chunk_replay(spark, sf_dir):
    """Replan every 4 steps with the 4-step chunk; step s plays row s % 4."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "actions")
    ch = W.action_chunk(f, 4).withColumnRenamed("actions", "chunk")
    plans = ch.filter(F.col("t") % 4 == 0)
    r = W.chunk_replay(f.select("episode_id", "t"), plans, 4)
    e = r.select("episode_id", "t", "block", "offset", F.posexplode("action").alias("dim", "action"))
    return e.withColumn("dim", F.col("dim").cast("bigint")).withColumn("action", R6("action"))


@query("asof_replay", f"""WITH {REPLAY_SQL}
SELECT f.episode_id, f.t, CAST((f.t // 7) * 7 AS BIGINT) AS plan_t, CAST(f.t % 7 AS BIGINT) AS "offset", CAST(d.dim AS BIGINT) AS dim,
       CASE d.dim WHEN 0 THEN {r6('a.s0')} ELSE {r6('a.s1')} END AS action
FROM frames_ev f JOIN len ON f.episode_id = len.episode_id
JOIN frames_ev a ON a.episode_id = f.episode_id AND a.t = least(f.t, len.last_t), (VALUES (0), (1)) d(dim)""")
def q_asof_replay(spark, sf_dir):
    """J9 as-of: plans every 7 steps with 7-step chunks; each step takes the latest plan."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "actions")
    ch = W.action_chunk(f, 7).withColumnRenamed("actions", "chunk")
    plans = ch.filter(F.col("t") % 7 == 0)
    r = W.asof_replay(f.select("episode_id", "t"), plans)
    e = r.select("episode_id", "t", "plan_t", "offset", F.posexplode("action").alias("dim", "action"))
    return e.withColumn("dim", F.col("dim").cast("bigint")).withColumn("action", R6("action"))


# ---------------------------------------------------------------- S15 / A11 logs
@query("log_extract", f"""WITH {LOG_LINES}
SELECT line_id, CAST(0 AS BIGINT) AS match_no, CAST(regexp_extract(text, 'step=(\\d+)\\s+loss=([\\d.]+)', 1) AS BIGINT) AS step,
       CAST(regexp_extract(text, 'step=(\\d+)\\s+loss=([\\d.]+)', 2) AS DOUBLE) AS loss
FROM log_lines""")
def q_log_extract(spark, sf_dir):
    e = EV.log_extract(views.log_lines(spark, sf_dir))
    return e.select("line_id", "match_no", "step", "loss")


@query("log_interval", f"""WITH {LOG_LINES},
m AS (SELECT CAST(regexp_extract(text, 'step=(\\d+)\\s+loss=([\\d.]+)', 1) AS BIGINT) AS step,
             CAST(regexp_extract(text, 'step=(\\d+)\\s+loss=([\\d.]+)', 2) AS DOUBLE) AS loss FROM log_lines)
SELECT CAST(ceil(step / CAST(100 AS DOUBLE)) AS BIGINT) AS "window", max(step) AS last_step, count(*) AS n,
       {r6('avg(loss)')} AS loss_mean,
       printf('ETA=%dh%02dm', CAST(floor((max(step) * 7) / 3600) AS BIGINT),
              CAST(floor(((max(step) * 7) % 3600) / 60) AS BIGINT)) AS eta
FROM m GROUP BY 1""")
def q_log_interval(spark, sf_dir):
    """Interval means, plus ETA text for 7 s per step over the remaining ``last_step`` steps."""
    li = EV.log_interval(EV.log_extract(views.log_lines(spark, sf_dir)), 100)
    return li.withColumn("loss_mean", R6("loss_mean")).withColumn("eta", EV.eta_text(F.col("last_step") * 7))


# ---------------------------------------------------------------- M14–M19 text features
def _ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("clean_prompt", f"""
SELECT doc_id, md5(translate({_ws('text')}, '_' || chr(10), '  ')) AS clean_a,
       length(translate({_ws('text')}, '_' || chr(10), '  ')) AS len_a,
       md5(translate({_ws('lower(text)')}, '_', ' ')) AS clean_b FROM documents""")
def q_clean_prompt(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    a = TX.clean_prompt_a("text")
    return docs.select("doc_id", F.md5(a).alias("clean_a"), F.length(a).cast("bigint").alias("len_a"),
                       F.md5(TX.clean_prompt_b("text")).alias("clean_b"))


@query("prompt_template", """
WITH b AS (SELECT vec_id, label, i,
                  CASE WHEN isnan(x) THEN 255 ELSE greatest(-1, least(255, CAST(floor((x + 1) * 128) AS INTEGER))) END AS bin
           FROM (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) * 4 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))),
s AS (SELECT vec_id, label, string_agg(CAST(bin AS VARCHAR), ' ' ORDER BY i) AS st FROM b GROUP BY vec_id, label)
SELECT vec_id, md5('Task: task ' || CAST(label AS VARCHAR) || ', State: ' || st || ';' || chr(10) || 'Action: ') AS prompt_a,
       md5('Task: task ' || CAST(label AS VARCHAR) || ', State: ' || st || ';' || chr(10)) AS prompt_b FROM s""")
def q_prompt_template(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("state", F.transform("state", lambda x: x * F.lit(4.0)))
    p = F.concat(F.lit(" task_"), F.col("task_index").cast("string"), F.lit("\n"))
    return v.select("vec_id", F.md5(TX.prompt_with_state(p, "state", True)).alias("prompt_a"),
                    F.md5(TX.prompt_with_state(p, "state", False)).alias("prompt_b"))


@query("pad_tokens", """
WITH tk AS (SELECT vec_id, i, greatest(-1, least(255, CAST(floor((CAST(embedding[i] AS DOUBLE) * 4 + 1) * 128) AS INTEGER))) AS tok
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
ls AS (SELECT unnest([48, 80]) AS l)
SELECT vec_id, CAST(l AS BIGINT) AS max_len, CAST(sum(CASE WHEN i <= l THEN tok ELSE 0 END) AS BIGINT) AS token_sum,
       CAST(least(64, l) AS BIGINT) AS n_mask, 64 > l AS truncated
FROM tk, ls GROUP BY vec_id, l""")
def q_pad_tokens(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    toks = V.discretize(F.transform("state", lambda x: x * F.lit(4.0)))
    out = None
    for L in (48, 80):
        t, m, tr = TX.pad_tokens(toks, L)
        o = v.select("vec_id", F.lit(L).cast("bigint").alias("max_len"),
                     F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("token_sum"),
                     F.size(F.filter(m, lambda x: x)).cast("bigint").alias("n_mask"), tr.alias("truncated"))
        out = o if out is None else out.unionByName(o)
    return out


@query("prefix_masks", """
WITH p AS (SELECT doc_id, n_chars % 200 AS p, 20 AS q FROM documents)
SELECT doc_id, CAST(least(p + q, 128) AS BIGINT) AS n_token, CAST(least(q, greatest(0, 128 - p)) AS BIGINT) AS n_ar,
       CAST(least(q, greatest(0, 128 - p)) AS BIGINT) AS n_loss, CAST(128 AS BIGINT) AS width FROM p""")
def q_prefix_masks(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    tok, ar, loss = TX.prefix_masks((F.col("n_chars") % 200).cast("int"), F.lit(20), 128)
    return docs.select("doc_id", F.size(F.filter(tok, lambda x: x)).cast("bigint").alias("n_token"),
                       F.aggregate(ar, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_ar"),
                       F.size(F.filter(loss, lambda x: x)).cast("bigint").alias("n_loss"),
                       F.size(tok).cast("bigint").alias("width"))


EXTRACT_SQL = """ex AS (SELECT conv_id, turn,
  CASE WHEN role = 'assistant' THEN role || ' Action: ' || text || ' | tail Action: more' ELSE text END AS t FROM conversations)"""


@query("extract_action_text", f"""WITH {EXTRACT_SQL}
SELECT conv_id, turn, md5(CASE WHEN contains(t, 'Action: ') THEN {_ws("split_part(split_part(t, 'Action: ', 2), '|', 1)")}
                          ELSE '' END) AS action_text FROM ex""")
def q_extract_action_text(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    t = F.when(F.col("role") == "assistant", F.concat(F.col("role"), F.lit(" Action: "), F.col("text"),
                                                       F.lit(" | tail Action: more"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(TX.extract_action_text(t)).alias("action_text"))


@query("success_running", f"""
SELECT event_id, event_type AS task,
       CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS successes,
       CAST(count(*) OVER w AS BIGINT) AS episodes,
       {r6('sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w / CAST(count(*) OVER w AS DOUBLE)')} AS rate
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def q_success_running(spark, sf_dir):
    """A7 running totals: success = value > 50, episodes in event order per task."""
    ev = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task"),
                                                    (F.col("value") > 50).alias("success"))
    r = EV.success_running(ev, "task", "event_id", "success")
    return r.select("event_id", "task", F.col("successes").cast("bigint"), F.col("episodes").cast("bigint"),
                    R6("rate").alias("rate"))


@query("unexpected_names", """
SELECT role, count(*) AS n FROM conversations WHERE role IS NULL OR role NOT IN ('assistant', 'user') GROUP BY role""")
def q_unexpected_names(spark, sf_dir):
    """Roles of conversations outside the two that have a slot."""
    from epiframe.functions.robots import unexpected_rows

    return unexpected_rows(views.table(spark, sf_dir, "conversations"), "role", ("assistant", "user"))
