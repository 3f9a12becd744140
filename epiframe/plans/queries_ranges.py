"""Registered queries: idle flags, keep ranges and range membership (step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.operators import ranges as RG
from epiframe.plans.catalog import query
from epiframe.plans.sqlviews import FRAMES_EV
from epiframe.sources import views

IDLE_SQL = f"""{FRAMES_EV},
v AS (SELECT episode_id, t, CAST(floor(s0 / CAST(60 AS DOUBLE)) AS DOUBLE) AS q FROM frames_ev),
f AS (SELECT episode_id, t,
             COALESCE(abs(q - lag(q) OVER (PARTITION BY episode_id ORDER BY t)) < CAST('0.001' AS DOUBLE), false) AS idle
      FROM v)"""

RANGES_SQL = f"""{IDLE_SQL},
i1 AS (SELECT *, t - row_number() OVER (PARTITION BY episode_id, idle ORDER BY t) AS isl FROM f),
l1 AS (SELECT *, count(*) OVER (PARTITION BY episode_id, idle, isl) AS rl FROM i1),
k AS (SELECT episode_id, t, NOT (idle AND rl >= 7) AS keep FROM l1),
i2 AS (SELECT *, t - row_number() OVER (PARTITION BY episode_id, keep ORDER BY t) AS isl FROM k),
r AS (SELECT episode_id, min(t) AS s, max(t) + 1 AS e, count(*) AS n FROM i2 WHERE keep GROUP BY episode_id, isl),
rr AS (SELECT episode_id, CAST(s AS BIGINT) AS start, CAST(e - 10 AS BIGINT) AS "end" FROM r WHERE n >= 16),
eps AS (SELECT DISTINCT episode_id FROM frames_ev),
ranges AS (SELECT eps.episode_id, rr.start, rr."end" FROM eps LEFT JOIN rr ON eps.episode_id = rr.episode_id)"""


def _ranges(spark, sf_dir):
    f = views.frames_idle(spark, sf_dir)
    return f, RG.nonidle_ranges(f, "vel")


@query("idle_flag", f"WITH {IDLE_SQL} SELECT episode_id, t, idle FROM f")
def q_idle_flag(spark, sf_dir):
    f = views.frames_idle(spark, sf_dir)
    return RG.idle_flag(f, "vel").select("episode_id", "t", "idle")


@query("nonidle_ranges", f"""WITH {RANGES_SQL}
SELECT episode_id, start IS NOT NULL AS has_range, COALESCE(start, -1) AS start, COALESCE("end", -1) AS "end"
FROM ranges""")
def q_nonidle_ranges(spark, sf_dir):
    """Keep ranges; an episode without any appears once with ``has_range = false`` (its empty list)."""
    r = _ranges(spark, sf_dir)[1]
    return r.select("episode_id", F.col("start").isNotNull().alias("has_range"),
                    F.coalesce("start", F.lit(-1)).cast("bigint").alias("start"),
                    F.coalesce("end", F.lit(-1)).cast("bigint").alias("end"))


@query("range_semi_join", f"""WITH {RANGES_SQL}
SELECT f.episode_id, f.t FROM frames_ev f
WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.episode_id = f.episode_id AND f.t >= r.start AND f.t < r."end")""")
def q_range_semi_join(spark, sf_dir):
    f, r = _ranges(spark, sf_dir)
    return RG.range_semi_join(f.select("episode_id", "t"), r)


@query("range_semi_join_exploded", f"""WITH {RANGES_SQL}
SELECT f.episode_id, f.t FROM frames_ev f
WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.episode_id = f.episode_id AND f.t >= r.start AND f.t < r."end")""")
def q_range_semi_join_exploded(spark, sf_dir):
    """Same membership through the large-ranges path (ranges exploded to frame keys)."""
    f, r = _ranges(spark, sf_dir)
    return RG.range_semi_join(f.select("episode_id", "t"), r, exploded=True)


RANGES_JSON_SQL = f"""{RANGES_SQL},
js AS (
  SELECT CAST(episode_id AS VARCHAR) AS episode_key, CAST(0 AS BIGINT) AS part,
         '[' || COALESCE(string_agg('[' || CAST(start AS VARCHAR) || ',' || CAST("end" AS VARCHAR) || ']', ','
                                    ORDER BY start) FILTER (WHERE start IS NOT NULL), '') || ']' AS ranges
  FROM ranges GROUP BY episode_id)"""


@query("ranges_json", f"WITH {RANGES_JSON_SQL} SELECT episode_key, part, ranges FROM js")
def q_ranges_json(spark, sf_dir):
    return RG.keep_ranges_json(_ranges(spark, sf_dir)[1])


@query("ranges_explode", f"""WITH {RANGES_SQL}
SELECT CAST(episode_id AS VARCHAR) AS episode_key, start, "end" FROM ranges WHERE start IS NOT NULL""")
def q_ranges_explode(spark, sf_dir):
    js = RG.keep_ranges_json(_ranges(spark, sf_dir)[1])
    return RG.read_keep_ranges(js)


@query("resume_anti_join", f"""WITH {RANGES_SQL}
SELECT DISTINCT episode_id FROM frames_ev
WHERE episode_id NOT IN (SELECT episode_id FROM ranges WHERE start IS NOT NULL)""")
def q_resume_anti_join(spark, sf_dir):
    f, r = _ranges(spark, sf_dir)
    done = r.filter(F.col("start").isNotNull())
    return RG.resume_anti_join(f.select("episode_id").distinct(), done)


@query("chunk_then_filter", f"""WITH {RANGES_SQL},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
kf AS (SELECT f.episode_id, f.t FROM frames_ev f
       WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.episode_id = f.episode_id AND f.t >= r.start AND f.t < r."end")),
pairs AS (SELECT episode_id, t, i, least(t + i, last_t) AS j FROM (
  SELECT k.episode_id, k.t, len.last_t, unnest(range(0, 4)) AS i FROM kf k JOIN len ON k.episode_id = len.episode_id))
SELECT p.episode_id, p.t, CAST(p.i AS BIGINT) AS i, CAST(d.dim AS BIGINT) AS dim,
       floor(CASE d.dim WHEN 0 THEN a.s0 ELSE a.s1 END * 1000000 + CAST('0.49997' AS DOUBLE)) / 1000000 AS value
FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j, (VALUES (0), (1)) d(dim)""")
def q_chunk_then_filter(spark, sf_dir):
    """Read-path order (trap 2): chunks are built on all frames, then the keep-range filter runs,
    so a kept frame's chunk may reach into dropped idle frames."""
    from epiframe.operators import windows as W
    from epiframe.session import r6 as R6

    f, r = _ranges(spark, sf_dir)
    ch = W.action_chunk(f.select("episode_id", "t", "actions"), 4)
    kept = RG.range_semi_join(ch, r)
    e = kept.select("episode_id", "t", F.posexplode("actions").alias("i", "a"))
    e = e.select("episode_id", "t", F.col("i").cast("bigint"), F.posexplode("a").alias("dim", "value"))
    return e.withColumn("dim", F.col("dim").cast("bigint")).withColumn("value", R6("value"))


#: Overlapping, touching, nested and very long ranges, from the events' own values.
OVERLAP_SQL = """ov AS (SELECT episode_id, t - 3 AS start, t - 3 + CAST(CASE WHEN t % 10 = 0 THEN 5000000000 ELSE floor(s1 / 10) END AS BIGINT) AS "end"
  FROM frames_ev WHERE t % 5 = 2 OR (t % 10 = 0 AND episode_id % 7 = 0))"""


def _overlapping(spark, sf_dir):
    f = views.frames_ev(spark, sf_dir)
    t, s1 = F.col("t"), F.col("state")[1]
    some = f.filter((t % 5 == 2) | ((t % 10 == 0) & (F.col("episode_id") % 7 == 0)))
    length = F.when(t % 10 == 0, F.lit(5_000_000_000.0)).otherwise(s1 / F.lit(10.0))
    return f, some.select("episode_id", (t - 3).alias("start"), (t - 3 + F.floor(length).cast("bigint")).alias("end"))


@query("coalesce_ranges", f"""WITH {FRAMES_EV}, {OVERLAP_SQL},
r AS (SELECT *, max("end") OVER (PARTITION BY episode_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM ov WHERE "end" > start),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT episode_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY episode_id, grp""")
def q_coalesce_ranges(spark, sf_dir):
    """Overlapping and touching ranges made one by a sweep."""
    return RG.coalesce_ranges(_overlapping(spark, sf_dir)[1])


@query("range_sweep_join", f"""WITH {FRAMES_EV}, {OVERLAP_SQL}
SELECT f.episode_id, f.t FROM frames_ev f
WHERE EXISTS (SELECT 1 FROM ov r WHERE r.episode_id = f.episode_id AND f.t >= r.start AND f.t < r."end")""")
def q_range_sweep_join(spark, sf_dir):
    """Membership in ranges of any length and overlap, no range listed or repeated."""
    f, r = _overlapping(spark, sf_dir)
    return RG.range_sweep_join(f.select("episode_id", "t"), r)


@query("ranges_document", f"WITH {RANGES_SQL}" + """,
per AS (SELECT CAST(episode_id AS VARCHAR) AS k, '[' || coalesce(string_agg('[' || start || ',' || "end" || ']', ',' ORDER BY start) FILTER (start IS NOT NULL), '') || ']' AS r
        FROM ranges GROUP BY episode_id)
SELECT '{' || string_agg('"' || k || '": ' || r, ',' ORDER BY k) || '}' AS doc FROM per""")
def q_ranges_document(spark, sf_dir):
    """K4: the lines written and read back; joined here only to compare them with the one document."""
    from epiframe.sinks import writers as WR
    from epiframe.streaming.streams import scratch

    path = scratch(spark, "ranges-doc")
    WR.write_document(RG.keep_ranges_document(_ranges(spark, sf_dir)[1], per_line=2), path)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                                         F.monotonically_increasing_id().alias("i"), "value")
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "b", "i", "value"))), lambda x: x["value"]), "").alias("doc"))
