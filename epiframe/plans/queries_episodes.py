"""Registered queries: discovery, modalities, alignment, episode index (step 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions import vectors as V
from epiframe.operators import episodes as E
from epiframe.plans.catalog import query
from epiframe.plans.sqlviews import FRAMES_LI, INSTRUCTIONS, MODALITIES, OBJECT_KEYS, r6
from epiframe.session import r6 as R6
from epiframe.sources import discovery as D
from epiframe.sources import views

CAMS = """cf AS (
  SELECT bucket, regexp_extract(key, '^(.*)raw_video/(cam_high|cam_left_wrist|cam_right_wrist)\\.mp4$', 1) AS prefix,
         regexp_extract(key, '^(.*)raw_video/(cam_high|cam_left_wrist|cam_right_wrist)\\.mp4$', 2) AS cam
  FROM object_keys WHERE regexp_matches(key, '^(.*)raw_video/(cam_high|cam_left_wrist|cam_right_wrist)\\.mp4$')),
vs AS (SELECT bucket, prefix, count(DISTINCT cam) AS nv,
              list_sort(list(DISTINCT cam)) AS views FROM cf GROUP BY bucket, prefix)"""


@query("discover_complete", f"WITH {OBJECT_KEYS}, {CAMS} SELECT bucket, prefix FROM vs WHERE nv = 3")
def q_discover_complete(spark, sf_dir):
    return D.discover_multiview(views.object_keys(spark, sf_dir))


@query("discover_missing", f"""WITH {OBJECT_KEYS}, {CAMS},
req AS (SELECT unnest(['cam_high', 'cam_left_wrist', 'cam_right_wrist']) AS cam),
miss AS (SELECT vs.bucket, vs.prefix, req.cam FROM vs, req WHERE NOT list_contains(vs.views, req.cam))
SELECT bucket, prefix, string_agg(cam, ',' ORDER BY cam) AS missing FROM miss GROUP BY bucket, prefix""")
def q_discover_missing(spark, sf_dir):
    m = D.missing_views(views.object_keys(spark, sf_dir))
    return m.select("bucket", "prefix", F.array_join("missing", ",").alias("missing"))


@query("top_episodes", f"""WITH {OBJECT_KEYS}, {CAMS}
SELECT bucket, prefix FROM vs WHERE nv = 3 ORDER BY bucket, prefix LIMIT 50""")
def q_top_episodes(spark, sf_dir):
    """Sorted complete episodes, first ``max_episodes`` (the limit is the feature)."""
    return D.discover_multiview(views.object_keys(spark, sf_dir), max_episodes=50)


@query("discover_single", f"""WITH {OBJECT_KEYS}
SELECT DISTINCT bucket, substring(key, 1, length(key) - 9) AS prefix FROM object_keys WHERE suffix(key, '/video.mp4')""")
def q_discover_single(spark, sf_dir):
    return D.discover_single(views.object_keys(spark, sf_dir))


@query("union_distinct", f"""WITH {OBJECT_KEYS}, {CAMS}
SELECT bucket, prefix FROM vs WHERE nv = 3
UNION
SELECT bucket, substring(key, 1, length(key) - 9) FROM object_keys WHERE suffix(key, '/video.mp4')""")
def q_union_distinct(spark, sf_dir):
    ok = views.object_keys(spark, sf_dir)
    return D.union_distinct_prefixes(D.discover_multiview(ok), D.discover_single(ok))


@query("discover_companions", f"""WITH {OBJECT_KEYS},
d AS (SELECT bucket, regexp_extract(key, '^(.*/)?([^/]+)$', 1) AS dir, regexp_extract(key, '^(.*/)?([^/]+)$', 2) AS file
      FROM object_keys),
have AS (SELECT bucket, dir FROM d WHERE file = 'video.mp4'
         INTERSECT SELECT bucket, dir FROM d WHERE file = 'eef_torso.pt'),
k AS (SELECT bucket, dir, CASE WHEN dir = '' THEN 0 WHEN regexp_matches(dir, '^[^/]+/$') THEN 1 ELSE 2 END AS kind FROM have),
fl AS (SELECT max(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS root_ok, max(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS child_ok FROM k)
SELECT bucket, dir FROM k, fl
WHERE CASE WHEN root_ok = 1 THEN kind = 0 WHEN child_ok = 1 THEN kind = 1 ELSE true END""")
def q_discover_companions(spark, sf_dir):
    return D.discover_companions(views.object_keys(spark, sf_dir))


@query("uri_split", f"""WITH {OBJECT_KEYS}
SELECT uri, regexp_extract(uri, '^[^:]+://([^/]*)/?(.*)$', 1) AS bucket, regexp_extract(uri, '^[^:]+://([^/]*)/?(.*)$', 2) AS key
FROM object_keys""")
def q_uri_split(spark, sf_dir):
    ok = views.object_keys(spark, sf_dir)
    b, k = D.uri_split("uri")
    return ok.select("uri", b.alias("bucket"), k.alias("key"))


@query("id_from_name", """
SELECT page_id, name, string_split(split_part(name, '.', 1), '_')[-1] AS episode_id FROM (
  SELECT page_id, 'metadata_' || replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '_') || '_'
         || CAST(page_id AS VARCHAR) || '.json' AS name FROM pages)""")
def q_id_from_name(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), r"\.", "_")
    name = F.concat(F.lit("metadata_"), host, F.lit("_"), F.col("page_id").cast("string"), F.lit(".json"))
    return p.select("page_id", name.alias("name")).withColumn("episode_id", D.id_from_name("name"))


@query("episode_subset", """
WITH l AS (SELECT url AS path, CAST(row_number() OVER (ORDER BY url) - 1 AS BIGINT) AS idx FROM pages)
SELECT path, idx FROM l WHERE idx IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_episode_subset(spark, sf_dir):
    listing = views.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    wanted = views.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("idx"))
    return D.episode_subset(listing, "path", wanted)


@query("instruction_json", f"""WITH {INSTRUCTIONS}
SELECT episode_id, CASE WHEN json_valid(json) THEN COALESCE(json_extract_string(json, '$.sub_instructions[0].instruction'),
       'Do something') ELSE 'Do something' END AS instruction FROM instr""")
def q_instruction_json(spark, sf_dir):
    ins = views.instructions(spark, sf_dir)
    return ins.select("episode_id", D.instruction_from_json("json").alias("instruction"))


# ---------------------------------------------------------------- modalities
MOD_FRAMES = f"""{FRAMES_LI}, {MODALITIES},
common AS (SELECT f.* FROM frames_li f JOIN head h ON f.episode_id = h.episode_id AND f.t = h.t)"""


def _mod_dims() -> str:
    parts = []
    for i in range(9):
        parts.append(f"SELECT episode_id, t, {i} AS dim, s0 + {i} AS x FROM common")
    parts += ["SELECT episode_id, t, 9, s2 FROM common", "SELECT episode_id, t, 10, s3 FROM common"]
    for i in range(9):
        parts.append(f"SELECT episode_id, t, {11 + i}, s1 / CAST(1000 AS DOUBLE) + {i} FROM common")
    parts.append("SELECT episode_id, t, 20, s2 * CAST(10 AS DOUBLE) FROM common")
    for i in range(9):
        parts.append(f"SELECT episode_id, t, {21 + i}, s0 - {i} FROM common")
    parts.append("SELECT episode_id, t, 30, s3 * CAST(10 AS DOUBLE) FROM common")
    return "\nUNION ALL ".join(parts)


@query("modality_concat", f"""WITH {MOD_FRAMES}, dims AS ({_mod_dims()})
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM dims""")
def q_modality_concat(spark, sf_dir):
    st = E.modality_concat(views.modalities(spark, sf_dir))
    return st.select("episode_id", "t", F.posexplode(V.listed("state")).alias("dim", "value")).select(
        "episode_id", "t", F.col("dim").cast("bigint"), R6("value").alias("value"))


@query("length_check", f"""WITH {FRAMES_LI}, {MODALITIES}
SELECT episode_id, min(n) AS min_len, max(n) AS max_len, min(n) = max(n) AS equal FROM mod_lengths GROUP BY episode_id""")
def q_length_check(spark, sf_dir):
    return E.length_check(E.modality_lengths(views.modalities(spark, sf_dir)))


@query("align_shortest", f"""WITH {FRAMES_LI}, {MODALITIES},
mins AS (SELECT episode_id, min(n) AS mn FROM mod_lengths GROUP BY episode_id)
SELECT f.episode_id, f.t FROM frames_li f JOIN mins m ON f.episode_id = m.episode_id WHERE f.t < m.mn""")
def q_align_shortest(spark, sf_dir):
    m = views.modalities(spark, sf_dir)
    return E.align_shortest(m["eef_torso"].select("episode_id", "t"), E.modality_lengths(m))


@query("downsample", f"""WITH {FRAMES_LI}
SELECT episode_id, CAST(t // 3 AS BIGINT) AS t, {r6('s0')} AS s0, {r6('s1')} AS s1, {r6('s2')} AS s2, {r6('s3')} AS s3 FROM frames_li WHERE t % 3 = 0""")
def q_downsample(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    return E.downsample(li, 3).select("episode_id", "t", *[R6(F.col("state")[j]).alias(f"s{j}") for j in range(4)])


@query("min_length", f"""WITH {FRAMES_LI}
SELECT episode_id, count(*) AS n FROM frames_li GROUP BY episode_id HAVING count(*) >= 4""")
def q_min_length(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    return E.min_length(li, 4).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))


EPISODE_INDEX_SQL = f"""{FRAMES_LI},
ds AS (SELECT episode_id, count(*) AS length FROM frames_li WHERE t % 3 = 0 GROUP BY episode_id),
ep AS (SELECT episode_id, length,
              CAST(sum(length) OVER (ORDER BY episode_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset"
       FROM ds)"""


def _episode_index(spark, sf_dir):
    return E.episode_table(E.downsample(views.frames_li(spark, sf_dir), 3))


@query("episode_index", f'WITH {EPISODE_INDEX_SQL} SELECT episode_id, length, "offset" FROM ep')
def q_episode_index(spark, sf_dir):
    return _episode_index(spark, sf_dir).select("episode_id", "length", "offset")


@query("global_to_local", f"""WITH {EPISODE_INDEX_SQL}
SELECT e.event_id AS idx, ep.episode_id, CAST(e.event_id - ep."offset" AS BIGINT) AS local
FROM events e JOIN ep ON e.event_id >= ep."offset" AND e.event_id < ep."offset" + ep.length""")
def q_global_to_local(spark, sf_dir):
    idx = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"))
    return E.global_to_local(idx, _episode_index(spark, sf_dir)).select("idx", "episode_id", "local")


@query("reject_report", f"""WITH {FRAMES_LI}, {MODALITIES},
lc AS (SELECT episode_id, min(n) AS mn, max(n) AS mx FROM mod_lengths GROUP BY episode_id),
rj AS (SELECT episode_id, CASE WHEN mn <> mx THEN 'length_mismatch' WHEN mn < 4 THEN 'too_short' END AS reason FROM lc)
SELECT reason, count(*) AS n FROM rj WHERE reason IS NOT NULL GROUP BY reason""")
def q_reject_report(spark, sf_dir):
    lc = E.length_check(E.modality_lengths(views.modalities(spark, sf_dir)))
    good, rejects = E.reject_split(lc, {"length_mismatch": ~F.col("equal"), "too_short": F.col("min_len") < 4})
    return E.reject_report(rejects)


@query("truncate_on_failure", f"""WITH {FRAMES_LI},
ff AS (SELECT episode_id, min(t) AS first_fail FROM frames_li WHERE task = 'R' GROUP BY episode_id)
SELECT f.episode_id, f.t FROM frames_li f LEFT JOIN ff ON f.episode_id = ff.episode_id
WHERE ff.first_fail IS NULL OR f.t < ff.first_fail""")
def q_truncate_on_failure(spark, sf_dir):
    """P17 with 'camera read failed' = return flag 'R'."""
    li = views.frames_li(spark, sf_dir).withColumn("failed", F.col("task") == "R")
    return E.truncate_on_failure(li, "failed").select("episode_id", "t")


@query("movement_filter", """
SELECT event_id FROM events WHERE COALESCE(event_type <> 'error', true)""")
def q_movement_filter(spark, sf_dir):
    """P16 with movement_enabled = (event_type <> 'error')."""
    ev = views.table(spark, sf_dir, "events").withColumn("movement_enabled", F.col("event_type") != "error")
    return E.movement_filter(ev).select("event_id")


@query("episode_best", """
SELECT user_id AS episode_id, max(value) AS best_reward, bool_or(event_type = 'purchase') AS done
FROM events GROUP BY user_id""")
def q_episode_best(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("done"))
    return E.episode_best(ev)


@query("fingerprint", f"""WITH {OBJECT_KEYS}, {CAMS}
SELECT bucket, prefix,
       md5('v1|' || bucket || '/' || prefix || '|rate=2|size=(224, 224)|multi_view=True|skip_video=False') AS fp_multi,
       md5('v1|' || bucket || '/' || prefix || '|rate=2|size=(224, 224)|multi_view=False|skip_video=False') AS fp_single
FROM vs WHERE nv = 3""")
def q_fingerprint(spark, sf_dir):
    """Cache identity per discovered episode; the multi-view flag changes it."""
    from epiframe.functions.hashing import fingerprint

    eps = D.discover_multiview(views.object_keys(spark, sf_dir))
    key = F.concat_ws("/", "bucket", "prefix")
    return eps.select("bucket", "prefix", fingerprint(key, 1, 2, (224, 224), True).alias("fp_multi"),
                      fingerprint(key, 1, 2, (224, 224), False).alias("fp_single"))
