"""Registered queries: vector maths, robot mappings, schema operators (steps 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions import robots as RB
from epiframe.functions import vectors as V
from epiframe.operators import schema as SC
from epiframe.operators import windows as W
from epiframe.plans.catalog import query
from epiframe.plans.queries_core import explode_chunk
from epiframe.plans.sqlviews import FRAMES_EV, FRAMES_LI, r6
from epiframe.session import r6 as R6
from epiframe.sources import views

D = "CAST('{}' AS DOUBLE)"


def d(v) -> str:
    return D.format(v)


def _long(df: DataFrame, col: str, keys=("episode_id", "t")) -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("dim", "value")).select(
        *keys, F.col("dim").cast("bigint"), R6("value").alias("value"))


def _ev(spark, sf_dir):
    return views.frames_ev(spark, sf_dir)


# ---------------------------------------------------------------- M5 delta / absolute
def _delta(spark, sf_dir):
    f = _ev(spark, sf_dir).select("episode_id", "t", "state", "actions")
    return W.action_chunk(f, 4).withColumn("actions", V.delta_actions("actions", "state", [True, False]))


CHUNK_SQL = f"""{FRAMES_EV},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
pairs AS (SELECT episode_id, t, i, least(t + i, last_t) AS j, st0 FROM (
  SELECT f.episode_id, f.t, f.s0 AS st0, len.last_t, unnest(range(0, 4)) AS i
  FROM frames_ev f JOIN len ON f.episode_id = len.episode_id)),
ch AS (SELECT p.episode_id, p.t, p.i, p.st0, a.s0, a.s1 FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j)"""


@query("delta_actions", f"""WITH {CHUNK_SQL}
SELECT episode_id, t, CAST(i AS BIGINT) AS i, CAST(0 AS BIGINT) AS dim, {r6('s0 - st0')} AS value FROM ch
UNION ALL SELECT episode_id, t, CAST(i AS BIGINT), CAST(1 AS BIGINT), {r6('s1')} FROM ch""")
def q_delta_actions(spark, sf_dir):
    return explode_chunk(_delta(spark, sf_dir), "actions", ["episode_id", "t"]).withColumn("value", R6("value"))


@query("absolute_actions", f"""WITH {CHUNK_SQL}
SELECT episode_id, t, CAST(i AS BIGINT) AS i, CAST(0 AS BIGINT) AS dim, {r6('(s0 - st0) + st0')} AS value FROM ch
UNION ALL SELECT episode_id, t, CAST(i AS BIGINT), CAST(1 AS BIGINT), {r6('s1')} FROM ch""")
def q_absolute_actions(spark, sf_dir):
    """Absolute after delta: the original chunk back (forward/inverse law)."""
    dl = _delta(spark, sf_dir)
    ab = dl.withColumn("actions", V.absolute_actions("actions", "state", [True, False]))
    return explode_chunk(ab, "actions", ["episode_id", "t"]).withColumn("value", R6("value"))


@query("chunk_stride", f"""WITH {FRAMES_EV},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
pairs AS (SELECT episode_id, t, i, least(t + i, last_t) AS j FROM (
  SELECT f.episode_id, f.t, len.last_t, unnest(range(0, 8)) AS i FROM frames_ev f JOIN len ON f.episode_id = len.episode_id))
SELECT p.episode_id, p.t, CAST(p.i // 3 AS BIGINT) AS i, CAST(d.dim AS BIGINT) AS dim, CASE d.dim WHEN 0 THEN {r6('a.s0')} ELSE {r6('a.s1')} END AS value
FROM pairs p JOIN frames_ev a ON a.episode_id = p.episode_id AND a.t = p.j, (VALUES (0), (1)) d(dim) WHERE p.i % 3 = 0""")
def q_chunk_stride(spark, sf_dir):
    f = _ev(spark, sf_dir).select("episode_id", "t", "actions")
    ch = W.action_chunk(f, 8).withColumn("actions", V.chunk_stride("actions", 3))
    return explode_chunk(ch, "actions", ["episode_id", "t"]).withColumn("value", R6("value"))


# ---------------------------------------------------------------- M10 pad, M12 first k
LI_LONG = """li_long AS (SELECT episode_id, t, 0 AS dim, s0 AS x FROM frames_li UNION ALL SELECT episode_id, t, 1, s1 FROM frames_li
  UNION ALL SELECT episode_id, t, 2, s2 FROM frames_li UNION ALL SELECT episode_id, t, 3, s3 FROM frames_li)"""


@query("pad_vectors", f"""WITH {FRAMES_LI}, {LI_LONG}
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM li_long
UNION ALL SELECT episode_id, t, CAST(p.dim AS BIGINT), CAST(0 AS DOUBLE) FROM frames_li, (VALUES (4), (5)) p(dim)""")
def q_pad_vectors(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    return _long(li.withColumn("state", V.pad_to_dim(V.pad_to_dim("state", 3), 6)), "state")


@query("first_k_dims", f"""WITH {FRAMES_LI}, {LI_LONG}
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM li_long WHERE dim < 3""")
def q_first_k(spark, sf_dir):
    li = views.frames_li(spark, sf_dir)
    return _long(li.withColumn("state", V.first_k("state", 3)), "state")


# ---------------------------------------------------------------- M13 discretize
@query("discretize", """
SELECT vec_id, CAST(d.i - 1 AS BIGINT) AS dim,
       CASE WHEN isnan(x) THEN 255 ELSE greatest(-1, least(255, CAST(floor((x + CAST(1 AS DOUBLE)) * CAST(128 AS DOUBLE)) AS INTEGER))) END AS bin
FROM (SELECT vec_id, d.i, CAST(embedding[d.i] AS DOUBLE) * CAST(4 AS DOUBLE) AS x
      FROM embeddings, (SELECT unnest(range(1, 65)) AS i) d) d""")
def q_discretize(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("state", F.transform("state", lambda x: x * F.lit(4.0)))
    out = v.select("vec_id", F.posexplode(V.discretize("state")).alias("dim", "bin"))
    return out.withColumn("dim", F.col("dim").cast("bigint"))


# ---------------------------------------------------------------- P25 clip + binarise
@query("clip_binarize", f"""WITH {FRAMES_EV},
v AS (SELECT episode_id, t, s0 / {d(100)} - {d(2)} AS a, s1 / {d(50)} - {d(1)} AS b, s0 / {d(500)} AS c FROM frames_ev)
SELECT episode_id, t, CAST(0 AS BIGINT) AS dim, {r6(f'greatest({d(-1)}, least({d(1)}, a))')} AS value FROM v
UNION ALL SELECT episode_id, t, 1, {r6(f'greatest({d(-1)}, least({d(1)}, b))')} FROM v
UNION ALL SELECT episode_id, t, 2, CASE WHEN c > {d(0.5)} THEN {d(1)} ELSE {d(0)} END FROM v""")
def q_clip_binarize(spark, sf_dir):
    f = _ev(spark, sf_dir)
    s = F.col("state")
    vec = F.array(s[0] / F.lit(100.0) - F.lit(2.0), s[1] / F.lit(50.0) - F.lit(1.0), s[0] / F.lit(500.0))
    return _long(f.withColumn("v", V.clip_binarize_last(vec)), "v")


# ---------------------------------------------------------------- M25 byte scaling
@query("byte_scale", f"""WITH {FRAMES_EV}
SELECT episode_id, t, {r6(f's1 / {d(255)} * {d(2)} - {d(1)}')} AS unit,
       CAST(trunc(s0 / {d(490.02)} * {d(255)}) AS BIGINT) AS byte FROM frames_ev""")
def q_byte_scale(spark, sf_dir):
    f = _ev(spark, sf_dir)
    s = F.col("state")
    u = V.byte_to_unit(F.array(s[1]))[0]
    b = V.unit_to_byte(F.array(s[0] / F.lit(490.02)))[0]
    return f.select("episode_id", "t", R6(u).alias("unit"), b.cast("bigint").alias("byte"))


# ---------------------------------------------------------------- M18 token remap, M20 bin decode
@query("token_remap", """
SELECT vec_id, CAST(d.i - 1 AS BIGINT) AS dim,
       CAST(257152 - 1 - 128 - (257152 - 1 - 128 - CAST(floor((CAST(embedding[d.i] AS DOUBLE) + 1) * 128) AS BIGINT)) AS BIGINT) AS token,
       CAST(257152 - 1 - 128 - CAST(floor((CAST(embedding[d.i] AS DOUBLE) + 1) * 128) AS BIGINT) AS BIGINT) AS remapped
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) d""")
def q_token_remap(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    toks = F.transform("state", lambda x: F.floor((x + F.lit(1.0)) * F.lit(128.0)).cast("bigint"))
    r = v.select("vec_id", toks.alias("tok")).withColumn("rm", V.token_remap("tok", 257152))
    r = r.withColumn("back", V.token_remap("rm", 257152))
    z = r.select("vec_id", F.posexplode(F.arrays_zip(F.col("back").alias("a"), F.col("rm").alias("b"))).alias("dim", "z"))
    return z.select("vec_id", F.col("dim").cast("bigint"), F.col("z.a").cast("bigint").alias("token"),
                    F.col("z.b").cast("bigint").alias("remapped"))


@query("bin_decode", """
WITH tk AS (SELECT vec_id, d.i - 1 AS k, CAST(floor((CAST(embedding[d.i] AS DOUBLE) + 1) * 128) AS BIGINT) AS tok
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i) d)
SELECT vec_id, CAST(k // 16 AS BIGINT) AS row, CAST(k % 16 AS BIGINT) AS col,
       floor((CAST(tok AS DOUBLE) / CAST(256 AS DOUBLE) * CAST(2 AS DOUBLE) - CAST(1 AS DOUBLE)) * 1000000 + CAST('0.49997' AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS value,
       false AS too_few
FROM tk
UNION ALL
SELECT vec_id, CAST(r AS BIGINT), CAST(c AS BIGINT), CAST(0 AS DOUBLE), true
FROM embeddings, (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 16)) AS c)""")
def q_bin_decode(spark, sf_dir):
    """4x16 decode (enough tokens) and 5x16 decode (too few → zeros) of the same 64 tokens."""
    v = views.vectors(spark, sf_dir)
    toks = F.transform("state", lambda x: F.floor((x + F.lit(1.0)) * F.lit(128.0)).cast("int"))
    base = v.select("vec_id", toks.alias("tok"))

    def long(df, h, flag):
        m = df.select("vec_id", F.posexplode(V.bin_decode("tok", h, 16)).alias("row", "_r"))
        m = m.select("vec_id", "row", F.posexplode("_r").alias("col", "value"))
        return m.select("vec_id", F.col("row").cast("bigint"), F.col("col").cast("bigint"), R6("value").alias("value"),
                        F.lit(flag).alias("too_few"))

    return long(base, 4, False).unionByName(long(base, 5, True))


# ---------------------------------------------------------------- M7–M9, M26 robot scalars
def _g(x: str) -> str:
    """SQL gripper linear → angular for expression x."""
    v = f"({x} * ({d(RB.PUPPET_GRIPPER_POSITION_OPEN)} - {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)}) + {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)})"
    ratio = f"(({d(RB.HORN_RADIUS)} * {d(RB.HORN_RADIUS)} + {v} * {v} - {d(RB.ARM_LENGTH)} * {d(RB.ARM_LENGTH)}) / ({d(2.0)} * {d(RB.HORN_RADIUS)} * {v}))"
    return f"((asin(greatest({d(-1)}, least({d(1)}, {ratio}))) - {d(RB.ANGULAR_LO)}) / ({d(RB.ANGULAR_HI)} - {d(RB.ANGULAR_LO)}))"


def _from_ang(x: str) -> str:
    return f"((({x}) + {d(RB.ANGULAR_LO)} - {d(RB.PUPPET_GRIPPER_JOINT_CLOSE)}) / ({d(RB.PUPPET_GRIPPER_JOINT_OPEN)} - {d(RB.PUPPET_GRIPPER_JOINT_CLOSE)}))"


@query("gripper_angular", f"""SELECT event_id, {r6(_g(f'value / {d(1000)}'))} AS value FROM events""")
def q_gripper_angular(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    return ev.select("event_id", R6(RB.gripper_to_angular(F.col("value") / F.lit(1000.0))).alias("value"))


@query("gripper_roundtrip", f"""SELECT event_id, {r6(f'{_from_ang("value")}')} AS encoded,
  {r6(f'{_from_ang("value")} * ({d(RB.PUPPET_GRIPPER_JOINT_OPEN)} - {d(RB.PUPPET_GRIPPER_JOINT_CLOSE)}) + {d(RB.PUPPET_GRIPPER_JOINT_CLOSE)} - {d(RB.ANGULAR_LO)}')} AS decoded FROM events""")
def q_gripper_roundtrip(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    enc = RB.gripper_from_angular(F.col("value"))
    return ev.select("event_id", R6(enc).alias("encoded"), R6(RB.gripper_from_angular_inv(enc)).alias("decoded"))


@query("rescale", f"""SELECT event_id,
  {r6(f'(value / {d(10000)} - {d(RB.MASTER_GRIPPER_POSITION_CLOSE)}) / ({d(RB.MASTER_GRIPPER_POSITION_OPEN)} - {d(RB.MASTER_GRIPPER_POSITION_CLOSE)}) * ({d(RB.PUPPET_GRIPPER_POSITION_OPEN)} - {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)}) + {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)}')} AS value
FROM events""")
def q_rescale(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    x = F.col("value") / F.lit(10000.0)
    return ev.select("event_id", R6(RB.rescale(x, RB.MASTER_GRIPPER_POSITION_CLOSE, RB.MASTER_GRIPPER_POSITION_OPEN,
                                              RB.PUPPET_GRIPPER_POSITION_CLOSE, RB.PUPPET_GRIPPER_POSITION_OPEN)).alias("value"))


def _arm_raw(spark, sf_dir):
    f = _ev(spark, sf_dir)
    s = F.col("state")
    seq = F.sequence(F.lit(0), F.lit(7))
    return f.select("episode_id", "t",
                    F.transform(seq, lambda i: s[0] / F.lit(1000.0) + i * F.lit(0.001)).alias("left"),
                    F.transform(seq, lambda i: s[1] / F.lit(1000.0) + i * F.lit(0.001)).alias("right"))


@query("assemble_dual_arm", f"""WITH {FRAMES_EV},
dims AS (SELECT unnest(range(0, 14)) AS dim),
v AS (SELECT episode_id, t, dim,
        CASE WHEN dim < 6 THEN s0 / {d(1000)} + dim * {d(0.001)}
             WHEN dim = 6 THEN ((s0 / {d(1000)} + 7 * {d(0.001)}) - {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)}) / ({d(RB.PUPPET_GRIPPER_POSITION_OPEN)} - {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)})
             WHEN dim < 13 THEN s1 / {d(1000)} + (dim - 7) * {d(0.001)}
             ELSE ((s1 / {d(1000)} + 7 * {d(0.001)}) - {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)}) / ({d(RB.PUPPET_GRIPPER_POSITION_OPEN)} - {d(RB.PUPPET_GRIPPER_POSITION_CLOSE)}) END AS x
      FROM frames_ev, dims)
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM v""")
def q_assemble_dual_arm(spark, sf_dir):
    raw = _arm_raw(spark, sf_dir)
    return _long(raw.withColumn("q", RB.assemble_dual_arm("left", "right")), "q")


def _arm14(spark, sf_dir, n=14):
    f = _ev(spark, sf_dir)
    s = F.col("state")
    return f.select("episode_id", "t", F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                                   lambda i: s[0] / F.lit(1000.0) + i * F.lit(0.01)).alias("state"))


FLIP = str(list(RB.JOINT_FLIP))


def _arm14_sql(n: int, fn) -> str:
    x = f"(s0 / {d(1000)} + dim * {d(0.01)})"
    fl = f"({x} * CAST({FLIP}[dim + 1] AS DOUBLE))"
    return f"""WITH {FRAMES_EV}, dims AS (SELECT unnest(range(0, {n})) AS dim)
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim,
       {r6(f'CASE WHEN dim IN (6, 13) THEN {fn(fl)} ELSE {fl} END')} AS value
FROM frames_ev, dims WHERE dim < 14"""


@query("map_dual_arm_in", _arm14_sql(14, _g))
def q_map_dual_arm_in(spark, sf_dir):
    return _long(_arm14(spark, sf_dir).withColumn("state", RB.decode_dual_arm_state("state")), "state")


@query("map_dual_arm_out", _arm14_sql(16, _from_ang))
def q_map_dual_arm_out(spark, sf_dir):
    a = _arm14(spark, sf_dir, 16).withColumn("actions", F.array(F.col("state")))
    a = a.withColumn("actions", RB.encode_dual_arm_actions("actions"))
    return _long(a.withColumn("v", F.col("actions")[0]), "v")


# ---------------------------------------------------------------- M21/M22 quaternion → axis angle, eef state
@query("quat_axis_angle", f"""WITH {FRAMES_EV},
q AS (SELECT episode_id, t, s0 / {d(1000)} AS qx, s1 / {d(1000)} AS qy, {d(0.1)} AS qz,
             greatest({d(-1)}, least({d(1)}, s1 / {d(100)})) AS w FROM frames_ev),
a AS (SELECT *, sqrt({d(1)} - w * w) AS den FROM q),
v AS (SELECT episode_id, t, 0 AS dim, s0 AS x FROM frames_ev
      UNION ALL SELECT episode_id, t, 1, s1 FROM frames_ev
      UNION ALL SELECT episode_id, t, 2, {d(0)} FROM frames_ev
      UNION ALL SELECT episode_id, t, 3, CASE WHEN den = 0 THEN {d(0)} ELSE qx * {d(2)} * acos(w) / den END FROM a
      UNION ALL SELECT episode_id, t, 4, CASE WHEN den = 0 THEN {d(0)} ELSE qy * {d(2)} * acos(w) / den END FROM a
      UNION ALL SELECT episode_id, t, 5, CASE WHEN den = 0 THEN {d(0)} ELSE qz * {d(2)} * acos(w) / den END FROM a
      UNION ALL SELECT episode_id, t, 6, s1 / {d(100)} FROM frames_ev
      UNION ALL SELECT episode_id, t, 7, -(s1 / {d(100)}) FROM frames_ev)
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM v""")
def q_quat_axis_angle(spark, sf_dir):
    f = _ev(spark, sf_dir)
    s = F.col("state")
    quat = F.array(s[0] / F.lit(1000.0), s[1] / F.lit(1000.0), F.lit(0.1), s[1] / F.lit(100.0))
    g = s[1] / F.lit(100.0)
    e = f.withColumn("eef", RB.eef_state(F.array(s[0], s[1], F.lit(0.0)), quat, F.array(g, -g)))
    return _long(e, "eef")


# ---------------------------------------------------------------- P18–P22 input mappings (masks, state layout)
CAM_SQL = """cams AS (
  SELECT conv_id,
         max(CASE WHEN role = 'user' THEN text END) AS cam_high,
         max(CASE WHEN role = 'assistant' THEN text END) AS cam_left_wrist,
         max(CASE WHEN role = 'system' THEN text END) AS cam_right_wrist
  FROM conversations GROUP BY conv_id)"""


def _cams(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("cam_high"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("cam_left_wrist"),
        F.max(F.when(F.col("role") == "system", F.col("text"))).alias("cam_right_wrist"))


@query("camera_masks", f"""WITH {CAM_SQL}
SELECT conv_id, true AS base_0_rgb, cam_left_wrist IS NOT NULL AS left_wrist_0_rgb,
       cam_right_wrist IS NOT NULL AS right_wrist_0_rgb FROM cams""")
def q_camera_masks(spark, sf_dir):
    """P18/P21 image masks: base always, wrists only when their view exists."""
    c = _cams(spark, sf_dir).withColumn("state", F.array(F.lit(0.0)))
    m = RB.map_arm31_in(c)
    return m.select("conv_id", *[F.col("image_mask")[k].alias(k) for k in
                                 ("base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb")])


@query("map_arm8", f"""WITH {FRAMES_LI}, {LI_LONG}
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM li_long
UNION ALL SELECT episode_id, t, CAST(4 AS BIGINT), {r6('s3 * CAST(10 AS DOUBLE)')} FROM frames_li""")
def q_map_arm8(spark, sf_dir):
    """state = joint_position ++ gripper (scalar gripper promoted to a 1-vector)."""
    li = views.frames_li(spark, sf_dir)
    li = li.select("episode_id", "t", F.col("state").alias("joint_position"),
                   (F.col("state")[3] * F.lit(10.0)).alias("gripper_position"))
    return _long(RB.map_arm8_in(li), "state")


@query("map_ur5", f"""WITH {FRAMES_LI}, {LI_LONG}
SELECT episode_id, t, CAST(dim AS BIGINT) AS dim, {r6('x')} AS value FROM li_long WHERE dim < 3
UNION ALL SELECT episode_id, t, CAST(3 AS BIGINT), {r6('s3')} FROM frames_li""")
def q_map_ur5(spark, sf_dir):
    """state = joints ++ gripper."""
    li = views.frames_li(spark, sf_dir)
    li = li.select("episode_id", "t", F.slice("state", 1, 3).alias("joints"), F.col("state")[3].alias("gripper"))
    return _long(RB.map_ur5_in(li), "state")


@query("map_arm7_out", f"""WITH {CHUNK_SQL}
SELECT episode_id, t, CAST(i AS BIGINT) AS i, CAST(0 AS BIGINT) AS dim, {r6('s0')} AS value FROM ch""")
def q_map_arm7_out(spark, sf_dir):
    """P20 outputs: first k dims of every chunk row (k=1 on 2-dim actions)."""
    f = _ev(spark, sf_dir).select("episode_id", "t", "actions")
    ch = RB.outputs_first_k(W.action_chunk(f, 4), 1)
    return explode_chunk(ch, "actions", ["episode_id", "t"]).withColumn("value", R6("value"))


# ---------------------------------------------------------------- P1–P6, P26–P28 schema operators
def _nested(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(
        F.struct(F.struct(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price")).alias("state"),
                 F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("meta")
                 ).alias("observation"),
        F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")).alias("key"),
        F.col("l_discount").alias("action"))


NESTED_SQL = "nested AS (SELECT l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_discount FROM lineitem)"


@query("repack", f"""WITH {NESTED_SQL}
SELECT l_quantity AS "state/qty", l_discount AS "actions", l_returnflag AS "prompt" FROM nested""")
def q_repack(spark, sf_dir):
    r = SC.repack(_nested(spark, sf_dir), {"state": {"qty": "observation/state/qty"}, "actions": "action",
                                           "prompt": "observation/meta/flag"})
    return SC.flatten_struct(r)


@query("flatten_struct", f"""WITH {NESTED_SQL}
SELECT l_quantity AS "observation/state/qty", l_extendedprice AS "observation/state/price",
       l_returnflag AS "observation/meta/flag", l_linestatus AS "observation/meta/status",
       l_orderkey AS "key/order", l_linenumber AS "key/line", l_discount AS action FROM nested""")
def q_flatten_struct(spark, sf_dir):
    """P5: flatten, unflatten, flatten again (round trip)."""
    return SC.flatten_struct(SC.unflatten_struct(SC.flatten_struct(_nested(spark, sf_dir))))


@query("regex_rename", f"""WITH {NESTED_SQL}
SELECT l_quantity AS "obs/state/qty", l_extendedprice AS "obs/state/price",
       l_orderkey AS "key/order", l_linenumber AS "key/line", l_discount AS actions FROM nested""")
def q_regex_rename(spark, sf_dir):
    """First full match wins, back-references, None drops."""
    pats = {"observation/meta/.*": None, r"observation/(.+)": r"obs/\1", "action": "actions", "key": None}
    return SC.flatten_struct(SC.regex_rename(_nested(spark, sf_dir), pats))


@query("drop_strings", f"""WITH {NESTED_SQL}
SELECT l_quantity AS "observation/state/qty", l_extendedprice AS "observation/state/price",
       l_orderkey AS "key/order", l_linenumber AS "key/line", l_discount AS action FROM nested""")
def q_drop_strings(spark, sf_dir):
    return SC.flatten_struct(SC.drop_strings(_nested(spark, sf_dir)))


@query("default_prompt", """SELECT event_id, event_type AS prompt, 'Do something' AS task FROM events""")
def q_default_prompt(spark, sf_dir):
    """A present column is kept; an absent one gets the default."""
    ev = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("prompt"))
    return SC.inject_default(SC.inject_default(ev, "prompt", "Do something"), "task", "Do something")


@query("unique_check", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_unique_check(spark, sf_dir):
    return SC.unique_check(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("record_summary", """
SELECT 'vec_id' AS path, 'bigint' AS dtype, -1 AS min_size, -1 AS max_size
UNION ALL SELECT 'embedding', 'array<float>', CAST(min(len(embedding)) AS INTEGER), CAST(max(len(embedding)) AS INTEGER) FROM embeddings
UNION ALL SELECT 'label', 'int', -1, -1""")
def q_record_summary(spark, sf_dir):
    """P28; sizes are -1 for non-array leaves."""
    r = SC.record_summary(views.table(spark, sf_dir, "embeddings"))
    return r.select("path", "dtype", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("min_size", "max_size")])
