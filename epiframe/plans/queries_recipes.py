"""Registered queries: recipes run end to end, forward and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions import robots as RB
from epiframe.functions.hashing import unit_hash_sql
from epiframe.functions.vectors import listed
from epiframe.operators import sampling as SM
from epiframe.plans import read_path as RP
from epiframe.plans import recipes as RC
from epiframe.plans.catalog import query
from epiframe.plans.queries_more import _feistel_sql
from epiframe.plans.queries_ranges import RANGES_SQL, _ranges
from epiframe.plans.queries_vectors import _from_ang, _g, d
from epiframe.plans.sqlviews import FRAMES_EV, r6, stats_sql
from epiframe.session import r6 as R6
from epiframe.sources import views

H = 2
TASKS_DEFAULT = "Stack the_cups"


# ---------------------------------------------------------------- the frames and their SQL
def _state_sql(dims: int) -> str:
    return "[" + ", ".join(f"s0 / {d(1000)} + {d(0.01 * j)}" if j % 2 == 0 else f"s1 / {d(1000)} - {d(0.01 * j)}" for j in range(dims)) + "]"


def _listed(exprs) -> str:
    return "[" + ", ".join(exprs) + "]"


def _arm_sql(dims: int, state, action, mask: list[bool], horizon: int = H) -> str:
    """CTEs ``arm`` (mapped state list ``ms``, action list ``ma``), ``ch`` (chunk rows less the masked state), ``vals``.

    ``state(x, j)`` and ``action(x, j)`` give the robot mapping's SQL for dim j of expression x.
    """
    ms = _listed(state(f"st[{j + 1}]", j) for j in range(dims))
    ma = _listed(action(f"(st[{j + 1}] * {d(2)} - {d(0.1)})", j) for j in range(dims))
    rows = _listed(f"a.ma[{j + 1}] - p.ms[{j + 1}]" if j < len(mask) and mask[j] else f"a.ma[{j + 1}]" for j in range(dims))
    return f"""{FRAMES_EV},
raw AS (SELECT episode_id, t, task, event_id, {_state_sql(dims)} AS st FROM frames_ev),
arm AS (SELECT *, {ms} AS ms, {ma} AS ma FROM raw),
len AS (SELECT episode_id, max(t) AS last_t FROM arm GROUP BY episode_id),
pairs AS (SELECT episode_id, t, ms, i, least(t + i, last_t) AS j FROM (
  SELECT arm.episode_id, arm.t, arm.ms, len.last_t, unnest(range(0, {horizon})) AS i FROM arm JOIN len ON arm.episode_id = len.episode_id)),
ch AS (SELECT p.episode_id, p.t, p.i, {rows} AS r FROM pairs p JOIN arm a ON a.episode_id = p.episode_id AND a.t = p.j),
vals AS (SELECT 'state' AS key, unnest(range(0, {dims})) AS dim, unnest(ms) AS x FROM arm
         UNION ALL SELECT 'actions', unnest(range(0, {dims})), unnest(r) FROM ch)"""


def _stats_row(dims: int, quantiles: bool) -> str:
    """CTE ``k``: one row, two lists per key (mean and std, or q01 and q99), unrounded."""
    body = stats_sql()
    body = body[:body.index("stats_out AS")]
    if quantiles:
        a, b = (f"qb.{q} * ((r.hi - r.lo) / {d(5000)}) + r.lo" for q in ("b01", "b99"))
    else:
        a, b = "m.mean", "m.std"
    return f"""{body}
ks AS (SELECT m.key, m.dim, {a} AS a, {b} AS b FROM m JOIN r ON m.key = r.key AND m.dim = r.dim JOIN qb ON m.key = qb.key AND m.dim = qb.dim),
k AS (SELECT list(a ORDER BY dim) FILTER (key = 'state') AS sa, list(b ORDER BY dim) FILTER (key = 'state') AS sb,
             list(a ORDER BY dim) FILTER (key = 'actions') AS aa, list(b ORDER BY dim) FILTER (key = 'actions') AS ab FROM ks)"""


def _norm(x: str, a: str, b: str, quantiles: bool) -> str:
    if quantiles:
        return f"(({x} - {a}) / ({b} - {a} + {d('1e-6')}) * {d(2)} - {d(1)})"
    return f"(({x} - {a}) / ({b} + {d('1e-6')}))"


def _wide(df: DataFrame, col: str, width: int, *keys) -> DataFrame:
    return df.select(*keys, *[R6(F.col(col)[j]).alias(f"d{j}") for j in range(width)])


def _forward_rows(out: DataFrame, width: int) -> DataFrame:
    """State (i = -1) and every chunk row of the samples, one column a dim: one pass over the samples."""
    rows = F.concat(F.array("state"), listed("actions"))
    made = out.select("episode_id", "t", F.posexplode(rows).alias("i", "row"))
    return _wide(made, "row", width, "episode_id", "t", (F.col("i") - 1).cast("bigint").alias("i"))


def _forward_sql(dims: int, width: int, quantiles: bool, arm: str) -> str:
    def cols(x: str, a: str, b: str) -> str:
        return ", ".join(f"{r6(_norm(f'{x}[{j + 1}]', f'k.{a}[{j + 1}]', f'k.{b}[{j + 1}]', quantiles))} AS d{j}" if j < dims
                         else f"{d(0)} AS d{j}" for j in range(width))

    return f"""WITH {arm}, {_stats_row(dims, quantiles)}
SELECT episode_id, t, CAST(-1 AS BIGINT) AS i, {cols('ms', 'sa', 'sb')} FROM arm, k
UNION ALL SELECT episode_id, t, CAST(i AS BIGINT) AS i, {cols('r', 'aa', 'ab')} FROM ch, k"""


def _inverse_sql(dims: int, horizon: int = H) -> str:
    """The robot's own chunk: what every exact inverse must return."""
    arm = _arm_sql(dims, lambda x, j: x, lambda x, j: x, [], horizon)
    cols = ", ".join(f"{r6(f'r[{j + 1}]')} AS d{j}" for j in range(dims))
    return f"WITH {arm} SELECT episode_id, t, CAST(i AS BIGINT) AS i, {cols} FROM ch"


def _inverse_rows(out: DataFrame, dims: int) -> DataFrame:
    rows = out.select("episode_id", "t", F.posexplode(listed("actions")).alias("i", "row"))
    return _wide(rows, "row", dims, "episode_id", "t", F.col("i").cast("bigint").alias("i"))


# ---------------------------------------------------------------- dual arm, flow family
DUAL = RC.recipe("dual_arm", horizon=H, width=16, prompt=TASKS_DEFAULT, token_len=24, actions="actions",
                 fields={"cam_high": "cam_high", "cam_left_wrist": "cam_left_wrist", "state": "state", "actions": "actions"})


def _flip_sql(fn):
    return lambda x, j: fn(f"({x} * {d(float(RB.JOINT_FLIP[j]))})") if j in RB.GRIPPER_DIMS else f"({x} * {d(float(RB.JOINT_FLIP[j]))})"


def _to_angular_inv(x: str) -> str:
    lo, hi = d(RB.PUPPET_GRIPPER_JOINT_CLOSE), d(RB.PUPPET_GRIPPER_JOINT_OPEN)
    return f"({x} * ({hi} - {lo}) + {lo} - {d(RB.ANGULAR_LO)})"


DUAL_SQL = _arm_sql(14, _flip_sql(_g), _flip_sql(_to_angular_inv), RC.V.make_bool_mask(*DUAL.delta))


def _samples(spark, sf_dir, r: RC.Recipe):
    frames = views.arm_frames(spark, sf_dir, r.dims)
    pipe = RC.build_recipe(r, RC.recipe_stats(r, frames))
    return pipe, pipe.forward(frames)


@query("recipe_dual_arm", _forward_sql(14, 16, False, DUAL_SQL))
def q_recipe_dual_arm(spark, sf_dir):
    """Chunk, flips and grippers on every chunk row, delta, z-scores, padding to 16."""
    return _forward_rows(_samples(spark, sf_dir, DUAL)[1], 16)


@query("recipe_dual_arm_inverse", _inverse_sql(14))
def q_recipe_dual_arm_inverse(spark, sf_dir):
    """The derived inverse returns the robot's own chunk."""
    pipe, made = _samples(spark, sf_dir, DUAL)
    return _inverse_rows(pipe.inverse(made), 14)


@query("recipe_dual_arm_views", f"""WITH {FRAMES_EV},
v AS (SELECT *, CAST(floor(s0) AS BIGINT) % 256 + CAST(floor(s1) AS BIGINT) % 256 + t % 256 AS total FROM frames_ev)
SELECT episode_id, t, true AS base_0_rgb, event_id % 3 <> 0 AS left_wrist_0_rgb, false AS right_wrist_0_rgb,
       CAST(total AS BIGINT) AS base_sum, CAST(CASE WHEN event_id % 3 <> 0 THEN total ELSE 0 END AS BIGINT) AS left_sum,
       CAST(0 AS BIGINT) AS right_sum, 3 AS right_size, 'Stack the cups' || chr(10) AS text, CAST(15 AS INTEGER) AS n_tokens FROM v""")
def q_recipe_dual_arm_views(spark, sf_dir):
    """View slots and masks (a missing view is a black image of the base's size), prompt ids of the flow family."""
    _, made = _samples(spark, sf_dir, DUAL)

    def total(slot):
        return F.aggregate(F.col(f"image.{slot}"), F.lit(0).cast("bigint"), lambda a, x: a + x)

    text = F.array_join(F.transform(F.filter("tokens", lambda c: c > 0), lambda c: F.char(c.cast("bigint"))), "")
    return made.select("episode_id", "t", *[F.col("image_mask")[k].alias(k) for k in ("base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb")],
                       total("base_0_rgb").alias("base_sum"), total("left_wrist_0_rgb").alias("left_sum"), total("right_wrist_0_rgb").alias("right_sum"),
                       F.size("image.right_wrist_0_rgb").alias("right_size"), text.alias("text"),
                       F.size(F.filter("token_mask", lambda x: x)).alias("n_tokens"))


# ---------------------------------------------------------------- 8 dims (7 joints and a gripper), quantile flow family
ARM8 = RC.recipe("arm8_positions", horizon=H, width=10, fields={
    "image": "cam_high", "wrist_image": "cam_left_wrist", "joint_position": "joint_position", "gripper_position": "gripper_position",
    "actions": "actions", "prompt": "prompt"})
ARM8_SQL = _arm_sql(8, lambda x, j: x, lambda x, j: x, RC.V.make_bool_mask(*ARM8.delta))


def _arm8(spark, sf_dir):
    f = views.arm_frames(spark, sf_dir, 8)
    f = f.withColumns({"joint_position": F.slice("state", 1, 7), "gripper_position": F.col("state")[7]}).drop("state")
    pipe = RC.build_recipe(ARM8, RC.recipe_stats(ARM8, f))
    return pipe, pipe.forward(f)


def _bin(x: str) -> str:
    return f"CAST(floor(greatest({d(-1)}, least({d(255)}, ({x} + {d(1)}) * {d(128)}))) AS INTEGER)"


@query("recipe_arm8", _forward_sql(8, 10, True, ARM8_SQL))
def q_recipe_arm8(spark, sf_dir):
    """Joints and gripper, delta of the joints, quantile scale, padding to 10."""
    return _forward_rows(_arm8(spark, sf_dir)[1], 10)


@query("recipe_arm8_inverse", _inverse_sql(8))
def q_recipe_arm8_inverse(spark, sf_dir):
    pipe, made = _arm8(spark, sf_dir)
    return _inverse_rows(pipe.inverse(made), 8)


_BINS8 = _listed(_bin(_norm(f"ms[{j + 1}]", f"k.sa[{j + 1}]", f"k.sb[{j + 1}]", True)) for j in range(8))


@query("recipe_arm8_prompt", f"""WITH {ARM8_SQL}, {_stats_row(8, True)},
p AS (SELECT episode_id, t, 'Task: ' || replace(trim(task), '_', ' ') || ', State: ' || array_to_string({_BINS8}, ' ') || ';' || chr(10) || 'Action: ' AS text
      FROM arm, k)
SELECT episode_id, t, text, CAST(length(text) AS INTEGER) AS n_tokens, true AS wrist_mask FROM p""")
def q_recipe_arm8_prompt(spark, sf_dir):
    """Prompt with the discretised state as ids, padded to 200 and masked."""
    _, made = _arm8(spark, sf_dir)
    text = F.array_join(F.transform(F.filter("tokens", lambda c: c > 0), lambda c: F.char(c.cast("bigint"))), "")
    return made.select("episode_id", "t", text.alias("text"), F.size(F.filter("token_mask", lambda x: x)).alias("n_tokens"),
                       F.col("image_mask")["left_wrist_0_rgb"].alias("wrist_mask"))


# ---------------------------------------------------------------- 7 dims, token family
ARM7 = RC.recipe("arm7", horizon=H, fields={"image": "cam_high", "wrist_image": "cam_left_wrist", "state": "state",
                                            "actions": "actions", "prompt": "prompt"})
ARM7_SQL = _arm_sql(7, lambda x, j: x, lambda x, j: x, [])
_ROW7 = _listed(_bin(_norm(f"r[{j + 1}]", f"k.aa[{j + 1}]", f"k.ab[{j + 1}]", True)) for j in range(7))
_BINS7 = _listed(_bin(_norm(f"ms[{j + 1}]", f"k.sa[{j + 1}]", f"k.sb[{j + 1}]", True)) for j in range(7))


@query("recipe_arm7", f"""WITH {ARM7_SQL}, {_stats_row(7, True)},
x AS (SELECT episode_id, t, flatten(list({_ROW7} ORDER BY i)) AS bins FROM ch, k GROUP BY episode_id, t),
p AS (SELECT arm.episode_id, arm.t, 'Task: ' || replace(lower(trim(task)), '_', ' ') || ', State: ' || array_to_string({_BINS7}, ' ') || ';' || chr(10) AS prefix,
             bins FROM arm JOIN x ON x.episode_id = arm.episode_id AND x.t = arm.t, k),
q AS (SELECT episode_id, t, length(prefix) AS np, 9 + len(bins) AS nq, list_concat(list_transform(string_split(prefix, ''), lambda c: unicode(c)),
        list_transform(string_split('Action: ', ''), lambda c: unicode(c)), list_transform(bins, lambda b: {257_152 - 1 - 128} - b), [unicode('|')]) AS ids FROM p)
SELECT episode_id, t, array_to_string(list_resize(ids, 180, 0), ',') AS tokens, CAST(np + nq AS INTEGER) AS n_tokens,
       CAST(nq AS INTEGER) AS n_ar, CAST(nq AS INTEGER) AS n_loss, true AS right_mask FROM q""")
def q_recipe_arm7(spark, sf_dir):
    """Prompt, state and chunk as one id sequence with token, order and loss masks (nothing masked out of the views)."""
    _, made = _samples(spark, sf_dir, ARM7)
    return made.select("episode_id", "t", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"),
                       F.size(F.filter("token_mask", lambda x: x)).alias("n_tokens"), F.size(F.filter("ar_mask", lambda x: x == 1)).alias("n_ar"),
                       F.size(F.filter("loss_mask", lambda x: x)).alias("n_loss"), F.col("image_mask")["right_wrist_0_rgb"].alias("right_mask"))


def _decoded(j: int) -> str:
    b = _bin(_norm(f"r[{j + 1}]", f"k.aa[{j + 1}]", f"k.ab[{j + 1}]", True))
    v = f"(CAST({b} AS DOUBLE) / {d(256)} * {d(2)} - {d(1)})"
    return f"({v} + {d(1)}) / {d(2)} * (k.ab[{j + 1}] - k.aa[{j + 1}] + {d('1e-6')}) + k.aa[{j + 1}]"


@query("recipe_arm7_inverse", f"""WITH {ARM7_SQL}, {_stats_row(7, True)}
SELECT episode_id, t, CAST(i AS BIGINT) AS i, {', '.join(f'{r6(_decoded(j))} AS d{j}' for j in range(7))} FROM ch, k""")
def q_recipe_arm7_inverse(spark, sf_dir):
    """Ids back to the robot's chunk, each value at its bin's lower edge."""
    pipe, made = _samples(spark, sf_dir, ARM7)
    return _inverse_rows(pipe.inverse(made.drop("actions")), 7)


# ---------------------------------------------------------------- 31 dims, quantile flow family, default prompt
ARM31 = RC.recipe("arm31", horizon=H)
ARM31_SQL = _arm_sql(31, lambda x, j: x, lambda x, j: x, RC.V.make_bool_mask(*ARM31.delta))


def _arm31(spark, sf_dir, r: RC.Recipe):
    f = views.arm_frames(spark, sf_dir, 31).drop("prompt")
    pipe = RC.build_recipe(r, RC.recipe_stats(r, f))
    return pipe, pipe.forward(f)


@query("recipe_arm31", _forward_sql(31, 32, True, ARM31_SQL))
def q_recipe_arm31(spark, sf_dir):
    """31 dims, delta of the three poses, quantile scale, padding to 32, default prompt."""
    return _forward_rows(_arm31(spark, sf_dir, ARM31)[1], 32)


@query("recipe_arm31_inverse", _inverse_sql(31, RC.RECIPES["arm31"].horizon))
def q_recipe_arm31_inverse(spark, sf_dir):
    """The preset as it is: chunks of its whole horizon (50) forward and back."""
    pipe, made = _arm31(spark, sf_dir, RC.recipe("arm31"))
    return _inverse_rows(pipe.inverse(made), 31)


# ---------------------------------------------------------------- P20, P21 inputs on their own
@query("map_arm7", f"""WITH {FRAMES_EV},
v AS (SELECT *, CAST(floor(s0) AS BIGINT) % 256 + CAST(floor(s1) AS BIGINT) % 256 + t % 256 AS total FROM frames_ev)
SELECT episode_id, t, family, true AS base_mask, true AS left_mask, family = 'tokens' AS right_mask, CAST(total AS BIGINT) AS base_sum,
       CAST(CASE WHEN event_id % 3 <> 0 THEN total ELSE 0 END AS BIGINT) AS left_sum, CAST(0 AS BIGINT) AS right_sum
FROM v, (VALUES ('flow'), ('tokens')) f(family)""")
def q_map_arm7(spark, sf_dir):
    """P20 inputs: the padded right wrist view counts as there in the token family only."""
    f = views.arm_frames(spark, sf_dir, 7).withColumnsRenamed({"cam_high": "image", "cam_left_wrist": "wrist_image"})
    return _slots(RB.map_arm7_in(f, "flow"), "flow").unionByName(_slots(RB.map_arm7_in(f, "tokens"), "tokens"))


def _slots(df: DataFrame, family: str) -> DataFrame:
    names = ("base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb")
    short = ("base", "left", "right")
    return df.select("episode_id", "t", F.lit(family).alias("family"), *[F.col("image_mask")[k].alias(f"{s}_mask") for s, k in zip(short, names)],
                     *[F.aggregate(F.col(f"image.{k}"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias(f"{s}_sum") for s, k in zip(short, names)])


@query("map_arm31", f"""WITH {FRAMES_EV},
v AS (SELECT *, CAST(floor(s0) AS BIGINT) % 256 + CAST(floor(s1) AS BIGINT) % 256 + t % 256 AS total FROM frames_ev)
SELECT episode_id, t, 'arm31' AS family, true AS base_mask, event_id % 3 <> 0 AS left_mask, false AS right_mask, CAST(total AS BIGINT) AS base_sum,
       CAST(CASE WHEN event_id % 3 <> 0 THEN total ELSE 0 END AS BIGINT) AS left_sum, CAST(0 AS BIGINT) AS right_sum FROM v""")
def q_map_arm31(spark, sf_dir):
    """P21 inputs: the dedicated base view where a row has it, else the single image; missing wrists black and masked."""
    f = views.arm_frames(spark, sf_dir, 31)
    f = f.withColumn("image", F.col("cam_high")).withColumn("cam_high", F.when(F.col("t") % 2 == 0, F.col("cam_high")))
    return _slots(RB.map_arm31_in(f), "arm31")


# ---------------------------------------------------------------- the read path
SAMPLES = 20_000
_WALK = _feistel_sql("n", SM.round_keys(4, 1), "x")


@query("read_path", f"""WITH RECURSIVE {RANGES_SQL},
len AS (SELECT episode_id, max(t) AS last_t FROM frames_ev GROUP BY episode_id),
kept AS (SELECT 'filtered' AS source, episode_id, t FROM frames_ev f WHERE episode_id % 2 = 0
           AND EXISTS (SELECT 1 FROM ranges r WHERE r.episode_id = f.episode_id AND f.t >= r.start AND f.t < r."end")
         UNION ALL SELECT 'whole', episode_id, t FROM frames_ev WHERE episode_id % 2 = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY episode_id, t) - 1 AS rw, count(*) OVER (PARTITION BY source) AS size FROM kept),
slots AS (SELECT slot, CASE WHEN {unit_hash_sql(['slot'], 4)} < CAST('0.7' AS DOUBLE) THEN 'filtered' ELSE 'whole' END AS source
          FROM (SELECT unnest(range(0, {SAMPLES})) AS slot)),
ks AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM slots),
first AS (SELECT CAST(slot AS BIGINT) AS id, CAST({SAMPLES} AS BIGINT) AS n, CAST(slot AS BIGINT) AS x FROM slots),
walk AS (SELECT * FROM ({_WALK.replace('FROM src', 'FROM first src')})
         UNION ALL SELECT * FROM ({_WALK.replace('FROM src', 'FROM (SELECT id, n, x FROM walk WHERE x >= n) src')})),
placed AS (SELECT id AS slot, x AS pos FROM walk WHERE x < n)
SELECT CAST(p.pos // 64 AS BIGINT) AS batch, p.pos, ks.source, m.episode_id, m.t, CAST(i.i AS BIGINT) AS i, {r6('a.s0')} AS a0, {r6('a.s1')} AS a1
FROM ks JOIN placed p ON p.slot = ks.slot JOIN numbered m ON m.source = ks.source AND m.rw = ks.k % m.size
JOIN len ON len.episode_id = m.episode_id, (SELECT unnest(range(0, 3)) AS i) i
JOIN frames_ev a ON a.episode_id = m.episode_id AND a.t = least(m.t + i.i, len.last_t) WHERE p.pos < {SAMPLES // 64 * 64}""")
def q_read_path(spark, sf_dir):
    """Chunk, keep-range filter, mix (0.7 / 0.3), shuffle of epoch 1, batches of 64, over {SAMPLES} samples."""
    f, r = _ranges(spark, sf_dir)
    f = f.select("episode_id", "t", "actions")
    even = RP.Source(f.filter("episode_id % 2 = 0"), 0.7, r)
    odd = RP.Source(f.filter("episode_id % 2 = 1"), 0.3)
    out = RP.read_path(spark, {"filtered": even, "whole": odd}, 3, SAMPLES, 64, seed=4, epoch=1)
    e = out.select("batch", "pos", "source", "episode_id", "t", F.posexplode("actions").alias("i", "a"))
    return e.select("batch", "pos", "source", "episode_id", "t", F.col("i").cast("bigint").alias("i"), R6(F.col("a")[0]).alias("a0"), R6(F.col("a")[1]).alias("a1"))
