"""Registered queries: Structured Streaming operators run to completion (step 8).

The given tables themselves are the streams (only the broker's calls, which need a
chunk each, are written out first, in one plan); each query runs to the end of what is
there and returns the sink; the oracle is the batch twin's SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.operators import windows as W
from epiframe.plans.catalog import query
from epiframe.plans.queries_more import REPLAY_SQL
from epiframe.plans.sqlviews import FRAMES_LI, LOG_LINES, r6
from epiframe.session import r6 as R6
from epiframe.sources import views
from epiframe.streaming import streams as ST



def _table_stream(spark, sf_dir, name):
    """The given table itself as a stream of files (by a pattern: the table may be one file or a folder of files)."""
    return ST.file_stream(spark, f"{sf_dir}/{name}.parque[t]", views.table(spark, sf_dir, name).schema)


_E = "CAST(pow(CAST(2 AS DOUBLE), e) AS DOUBLE)"


@query("stream_stats", f"""WITH v AS (SELECT 0 AS dim, CAST(value AS DOUBLE) AS x FROM events
  UNION ALL SELECT 1, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events),
m AS (SELECT dim, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx FROM v GROUP BY dim),
w AS (SELECT dim, min(e) AS e FROM m, (SELECT unnest(range(-300, 301)) AS e) WHERE floor(mx / {_E}) - floor(mn / {_E}) < 5000
        AND greatest(abs(mn), abs(mx)) < {_E} * CAST(4503599627370496 AS DOUBLE) GROUP BY dim),
h AS (SELECT v.dim, floor(x / {_E}) AS bin, count(*) AS c FROM v JOIN w ON w.dim = v.dim WHERE x IS NOT NULL GROUP BY ALL),
hc AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto FROM h),
q AS (SELECT m.dim, min(CASE WHEN upto >= CAST('0.01' AS DOUBLE) * n THEN bin END) AS b01,
             min(CASE WHEN upto >= CAST('0.99' AS DOUBLE) * n THEN bin END) AS b99 FROM hc JOIN m ON m.dim = hc.dim GROUP BY m.dim)
SELECT 'state' AS key, CAST(m.dim AS BIGINT) AS dim, n AS count, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mn')} AS min, {r6('mx')} AS max,
       {r6(f'greatest(mn, b01 * {_E})')} AS q01, {r6(f'greatest(mn, b99 * {_E})')} AS q99
FROM m JOIN w ON w.dim = m.dim JOIN q ON q.dim = m.dim""")
def q_stream_stats(spark, sf_dir):
    """Moments and quantiles over the events as they arrive; bins grow with the range."""
    state = F.array(F.col("value").cast("double"), F.get_json_object("props", "$.k").cast("double"))
    stream = _table_stream(spark, sf_dir, "events").select(state.alias("state"))
    st = ST.stream_stats(spark, stream, {"state": "state"}, ST.scratch(spark, "stats-out"))
    return st.select("key", "dim", "count", *[R6(c).alias(c) for c in ("mean", "std", "min", "max", "q01", "q99")])


@query("stream_broker", f"""WITH {REPLAY_SQL}
SELECT f.episode_id, f.t, CAST(d.dim AS BIGINT) AS dim, CASE d.dim WHEN 0 THEN {r6('a.s0')} ELSE {r6('a.s1')} END AS action
FROM frames_ev f JOIN len ON f.episode_id = len.episode_id
JOIN frames_ev a ON a.episode_id = f.episode_id AND a.t = least(f.t, len.last_t), (VALUES (0), (1)) d(dim)""")
def q_stream_broker(spark, sf_dir):
    """R2: broker over a stream of calls, each with the chunk a policy would give (h = 4); equals the batch chunk replay."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "actions")
    steps = W.action_chunk(f, 4).withColumnRenamed("actions", "plan")
    path = ST.scratch(spark, "broker")
    steps.write.parquet(path)
    out = ST.stream_broker(spark, ST.file_stream(spark, path, steps.schema), 4, ST.scratch(spark, "broker-out"))
    e = out.select("episode_id", "t", F.posexplode("action").alias("dim", "action"))
    return e.select("episode_id", "t", F.col("dim").cast("bigint").alias("dim"), R6("action").alias("action"))


@query("stream_newest", """
WITH e AS (SELECT event_id, event_type, ts,
                  max(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
           FROM events)
SELECT event_id, event_type AS channel FROM e WHERE prev IS NULL OR ts > prev""")
def q_stream_newest(spark, sf_dir):
    """Readings arriving user by user; equals batch newest-only."""
    ev = _table_stream(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("channel"), "ts")
    return ST.stream_newest(spark, ev, ST.scratch(spark, "newest-out"), arrival=["user_id", "event_id"]).select("event_id", "channel")


@query("stream_rate", f"""WITH e AS (SELECT event_id, event_type AS channel, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS sec,
    CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM events),
w AS (SELECT *, count(*) OVER k AS n, max(sec) OVER k - min(sec) OVER k AS span FROM e
      WINDOW k AS (PARTITION BY channel ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, channel, seq, CASE WHEN n > 1 AND span > 0 THEN {r6('(n - 1) / span')} END AS rate FROM w""")
def q_stream_rate(spark, sf_dir):
    """Reading rate over each channel's last 50 times; equals the batch rate."""
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    ev = _table_stream(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), sec.alias("ts"))
    out = ST.stream_rate(spark, ev, ST.scratch(spark, "rate-out"), arrival=["ts", "event_id"])
    return out.select("event_id", "channel", "seq", R6("rate").alias("rate"))


@query("stream_log", f"""WITH {LOG_LINES},
m AS (SELECT CAST(regexp_extract(text, 'step=(\\d+)\\s+loss=([\\d.]+)', 1) AS BIGINT) AS step,
             CAST(regexp_extract(text, 'step=(\\d+)\\s+loss=([\\d.]+)', 2) AS DOUBLE) AS loss FROM log_lines)
SELECT CAST(ceil(step / CAST(100 AS DOUBLE)) AS BIGINT) AS "window", max(step) AS last_step, count(*) AS n,
       {r6('avg(loss)')} AS loss_mean FROM m GROUP BY 1""")
def q_stream_log(spark, sf_dir):
    """Interval means over an unbounded log stream; equals the batch log_interval."""
    lines = views.log_lines_of(_table_stream(spark, sf_dir, "orders"))
    out = ST.stream_log(spark, lines, 100, ST.scratch(spark, "log-out"))
    return out.withColumn("loss_mean", R6("loss_mean"))


@query("stream_ingest", f"""WITH {FRAMES_LI},
lens AS (SELECT episode_id, count(*) AS n FROM frames_li GROUP BY episode_id)
SELECT episode_id, CASE WHEN n < 4 THEN 'too_short' ELSE 'good' END AS reason, n FROM lens""")
def q_stream_ingest(spark, sf_dir):
    """Frames arrive in any order and batch; episodes are judged whole once the source has ended."""
    li = _table_stream(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), "l_linenumber", "l_quantity")
    done = ST.Ingest(spark, li.schema, 4, ST.scratch(spark, "ingest-out")).run(li).close()
    good = done.good().groupBy("episode_id").agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n"))
    return done.rejects().unionByName(good)
