"""SQL text of the test views and shared oracle fragments (DuckDB dialect).

The oracle never uses our Spark code: each view is restated from the
driver tables with plain SQL windows.
"""

from __future__ import annotations


def r6(expr: str) -> str:
    """Same rounding as ``epiframe.session.r6``."""
    return f"(floor(({expr}) * CAST(1000000 AS DOUBLE) + CAST('0.49997' AS DOUBLE)) / CAST(1000000 AS DOUBLE))"


FRAMES_EV = """frames_ev AS (
  SELECT user_id AS episode_id, event_id, ts, event_type AS task,
         CAST(value AS DOUBLE) AS s0,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s1,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t
  FROM events)"""

FRAMES_LI = """frames_li AS (
  SELECT l_orderkey AS episode_id, l_returnflag AS task,
         CAST(l_quantity AS DOUBLE) AS s0, CAST(l_extendedprice AS DOUBLE) AS s1,
         CAST(l_discount AS DOUBLE) AS s2, CAST(l_tax AS DOUBLE) AS s3,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS t
  FROM lineitem)"""

OBJECT_KEYS = r"""pg AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bucket,
         regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '\.html$', ''), '/+$', '') AS prefix
  FROM pages),
pf AS (
  SELECT page_id, bucket, prefix, f.pos, f.file FROM pg, (VALUES
    (0, 'raw_video/cam_high.mp4'), (1, 'raw_video/cam_left_wrist.mp4'), (2, 'raw_video/cam_right_wrist.mp4'),
    (3, 'raw_video/cam_low.mp4'), (4, 'video.mp4'), (5, 'eef_torso.pt')) AS f(pos, file)
  WHERE (page_id * 7 + f.pos * 3) % 5 <> 0 OR f.pos = 0),
object_keys AS (
  SELECT bucket, concat_ws('/', prefix, file) AS key,
         concat('s3://', bucket, '/', concat_ws('/', prefix, file)) AS uri
  FROM pf)"""

LOG_LINES = """log_lines AS (
  SELECT o_orderkey AS line_id,
         concat('[', o_orderstatus, '] step=', CAST(o_orderkey AS VARCHAR), ' loss=',
                CAST(CAST(floor(o_totalprice) AS BIGINT) // 100000 AS VARCHAR), '.',
                lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS VARCHAR), 5, '0'),
                ' lr=0.0001 grad_norm=1.5 data_time=0.01s') AS text
  FROM orders)"""


def stats_sql(vals: str = "vals", bins: int = 5000) -> str:
    """Moments + two-pass histogram quantiles over a CTE ``vals(key, dim, x)``.

    Returns CTE text ending in ``stats_out`` (no leading WITH).
    """
    d = "CAST({} AS DOUBLE)"
    return f"""m AS (
  SELECT key, dim, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx
  FROM {vals} GROUP BY key, dim),
r AS (SELECT key, dim, mn - {d.format("'1e-10'")} AS lo, mx + {d.format("'1e-10'")} AS hi, n FROM m),
h AS (
  SELECT v.key, v.dim, CAST(least({bins - 1}, floor((v.x - r.lo) * ({d.format(bins)} / (r.hi - r.lo)))) AS INTEGER) AS bin,
         count(*) AS c
  FROM {vals} v JOIN r ON v.key = r.key AND v.dim = r.dim GROUP BY ALL),
hc AS (SELECT h.*, sum(c) OVER (PARTITION BY key, dim ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM h),
qb AS (
  SELECT hc.key, hc.dim,
         min(CASE WHEN cum >= {d.format("'0.01'")} * r.n THEN bin END) AS b01,
         min(CASE WHEN cum >= {d.format("'0.99'")} * r.n THEN bin END) AS b99
  FROM hc JOIN r ON hc.key = r.key AND hc.dim = r.dim GROUP BY hc.key, hc.dim),
stats_out AS (
  SELECT m.key, CAST(m.dim AS BIGINT) AS dim, CAST(m.n AS BIGINT) AS count,
         {r6('m.mean')} AS mean, {r6('m.std')} AS std, {r6('m.mn')} AS min, {r6('m.mx')} AS max,
         {r6(f'qb.b01 * ((r.hi - r.lo) / {d.format(bins)}) + r.lo')} AS q01,
         {r6(f'qb.b99 * ((r.hi - r.lo) / {d.format(bins)}) + r.lo')} AS q99
  FROM m JOIN r ON m.key = r.key AND m.dim = r.dim JOIN qb ON m.key = qb.key AND m.dim = qb.dim)"""

MODALITIES = """li_last AS (SELECT episode_id, max(t) AS last_t FROM frames_li GROUP BY episode_id),
head AS (SELECT f.episode_id, f.t FROM frames_li f JOIN li_last l ON f.episode_id = l.episode_id
         WHERE NOT (f.t = l.last_t AND f.task = 'R')),
mod_lengths AS (
  SELECT episode_id, 'eef_torso' AS modality, count(*) AS n FROM frames_li GROUP BY episode_id
  UNION ALL SELECT episode_id, 'eef_left', count(*) FROM frames_li GROUP BY episode_id
  UNION ALL SELECT episode_id, 'eef_right', count(*) FROM frames_li GROUP BY episode_id
  UNION ALL SELECT episode_id, 'gripper_cmd', count(*) FROM frames_li GROUP BY episode_id
  UNION ALL SELECT episode_id, 'head', count(*) FROM head GROUP BY episode_id)"""

INSTRUCTIONS = r"""conv_u AS (
  SELECT conv_id,
         string_agg(CASE WHEN role = 'user'
                         THEN '{"instruction":"' || regexp_replace(text, '["\\\r\n\t]', ' ', 'g') || '"}' END,
                    ',' ORDER BY turn) AS items,
         max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS sys
  FROM conversations GROUP BY conv_id),
instr AS (
  SELECT conv_id AS episode_id,
         CASE WHEN sys = 1 THEN substring(d, 1, length(d) - 2) ELSE d END AS json
  FROM (SELECT conv_id, sys, '{"sub_instructions":[' || COALESCE(items, '') || ']}' AS d FROM conv_u))"""
