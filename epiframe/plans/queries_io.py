"""Registered queries: sources, sinks, pipelines and recipes (steps 4–6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiframe.functions.hashing import hash_key_sql, unit_hash_sql
from epiframe.functions.vectors import make_bool_mask
from epiframe.operators import schema as SC
from epiframe.operators import stats as S
from epiframe.plans import recipes as RC
from epiframe.plans.catalog import query
from epiframe.plans.pipeline import Pipeline, map_batches
from epiframe.plans.queries_core import LI_STATS_SQL, _li_stats, _long_vec
from epiframe.plans.sqlviews import FRAMES_EV, FRAMES_LI, r6
from epiframe.session import join_small
from epiframe.session import r6 as R6
from epiframe.sinks import writers as WR
from epiframe.sources import readers as RD
from epiframe.sources import views
from epiframe.streaming.streams import scratch


@query("src_frames", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, n.n_name AS prompt
FROM lineitem l LEFT JOIN nation n ON n.n_nationkey = l.l_linenumber""")
def q_src_frames(spark, sf_dir):
    """Frame table with the tasks dimension (task_index = line number) and pruned columns."""
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                      F.col("l_linenumber").alias("task_index"))
    tasks = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task_index"), F.col("n_name").alias("prompt"))
    return join_small(li, tasks, ["task_index"], "left").drop("task_index")


@query("src_nested_explode", """
SELECT conv_id AS episode_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS t,
       turn, role, md5(text) AS text_md5 FROM conversations""")
def q_src_nested_explode(spark, sf_dir):
    """Episodes nested as ``steps ARRAY<STRUCT>`` (one record each), exploded back to steps."""
    c = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), "turn", "role", "text")
    nested = RD.nest_steps(c.withColumn("t", F.col("turn")), ["turn", "role", "text"], max_steps=4)
    steps = RD.explode_steps(nested, base="first_step")
    return steps.select("episode_id", "t", "turn", "role", F.md5("text").alias("text_md5"))


@query("optional_columns", """
SELECT count(*) AS rows, 'l_discount' AS "column", count(l_discount) AS present_rows FROM lineitem
UNION ALL SELECT count(*), 'l_tax', count(l_tax) FROM lineitem""")
def q_optional_columns(spark, sf_dir):
    """Optional velocity/effort-like columns (probe by schema; count presence over all rows)."""
    li = views.table(spark, sf_dir, "lineitem")
    return RD.presence_report(li, ["l_discount", "l_tax", "velocity", "effort"]).select("rows", "column", "present_rows")


@query("nested_drop_fields", """
SELECT l_quantity AS "observation/state/qty", l_returnflag AS "observation/meta/flag", l_discount AS action FROM lineitem""")
def q_nested_drop_fields(spark, sf_dir):
    """Nested groups with ignored keys removed (``dropFields`` on nested paths)."""
    li = views.table(spark, sf_dir, "lineitem")
    nested = li.select(F.struct(F.struct(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price")).alias("state"),
                                F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("meta"))
                       .alias("observation"), F.col("l_discount").alias("action"))
    out = RD.drop_nested_fields(nested, "observation", ["state.price", "meta.status"])
    return SC.flatten_struct(out)


@query("records_pivot", f"""WITH {FRAMES_EV}
SELECT episode_id, t, CAST(0 AS BIGINT) AS dim, {r6('s0')} AS inputs, {r6('s0 * CAST(2 AS DOUBLE)')} AS outputs FROM frames_ev
UNION ALL SELECT episode_id, t, CAST(1 AS BIGINT), {r6('s1')}, {r6('s1 * CAST(2 AS DOUBLE)')} FROM frames_ev""")
def q_records_pivot(spark, sf_dir):
    """Per-step records (inputs/state, outputs/actions) → per-dimension series."""
    f = views.frames_ev(spark, sf_dir)
    rec = f.select("episode_id", "t", F.col("state").alias("inputs"), F.transform("state", lambda x: x * F.lit(2.0)).alias("outputs"))
    p = RD.records_pivot(rec, {"inputs": "inputs", "outputs": "outputs"}, ["episode_id", "t"])
    return p.select("episode_id", "t", "dim", R6("inputs").alias("inputs"), R6("outputs").alias("outputs"))


@query("to_frame_table", f"""WITH {FRAMES_EV},
ep AS (SELECT episode_id, CAST(row_number() OVER (ORDER BY episode_id) - 1 AS BIGINT) AS episode_index
       FROM (SELECT DISTINCT episode_id FROM frames_ev)),
tk AS (SELECT task, CAST(row_number() OVER (ORDER BY task) - 1 AS BIGINT) AS task_index FROM (SELECT DISTINCT task FROM frames_ev))
SELECT f.episode_id, ep.episode_index, f.t AS frame_index, {r6('f.t / CAST(15 AS DOUBLE)')} AS timestamp, tk.task_index
FROM frames_ev f JOIN ep ON f.episode_id = ep.episode_id JOIN tk ON f.task = tk.task""")
def q_to_frame_table(spark, sf_dir):
    """K1/M24 at 15 fps: dense episode and task indices, frame index and timestamp."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "task")
    out = WR.to_frame_table(f, 15)
    return out.select("episode_id", "episode_index", "frame_index", R6("timestamp").alias("timestamp"), "task_index")


@query("stats_json_roundtrip", f"""WITH {LI_STATS_SQL}
SELECT key, CAST(dim AS BIGINT) AS dim, {r6('mean')} AS mean, {r6('std')} AS std, {r6('q01')} AS q01,
       {r6('q99')} AS q99 FROM raw""")
def q_stats_json_roundtrip(spark, sf_dir):
    """K3: stats → one JSON document → parsed back to long form."""
    _, st = _li_stats(spark, sf_dir)
    back = S.stats_from_json(S.stats_json(st))
    return back.select("key", "dim", *[R6(c).alias(c) for c in ("mean", "std", "q01", "q99")])


_LI_Q = "(x - q01) / (q99 - q01 + CAST('1e-6' AS DOUBLE)) * CAST(2 AS DOUBLE) - CAST(1 AS DOUBLE)"


@query("sample_assembly", f"""WITH {LI_STATS_SQL},
fl AS (SELECT episode_id, t, 0 AS dim, s0 AS x FROM frames_li UNION ALL SELECT episode_id, t, 1, s1 FROM frames_li
       UNION ALL SELECT episode_id, t, 2, s2 FROM frames_li UNION ALL SELECT episode_id, t, 3, s3 FROM frames_li)
SELECT f.key, fl.episode_id, fl.t, CAST(fl.dim AS BIGINT) AS dim, {r6(_LI_Q)} AS value
FROM fl JOIN raw ON raw.dim = fl.dim AND raw.key = 'state', (VALUES ('state'), ('actions')) f(key)
UNION ALL SELECT f.key, episode_id, t, CAST(p.dim AS BIGINT), CAST(0 AS DOUBLE) FROM frames_li, (VALUES (4), (5)) p(dim), (VALUES ('state'), ('actions')) f(key)""")
def q_sample_assembly(spark, sf_dir):
    """The lineitem frames through a whole recipe (quantile family, one-row chunks, padding to 6): state and actions."""
    li, _ = _li_stats(spark, sf_dir)
    spec = RC.Recipe("lineitem", "plain", "flow_q", horizon=1, dims=4, width=6, prompt="Do something", token_len=64,
                     fields={"state": "state", "actions": "actions"})
    out = RC.build_recipe(spec, RC.recipe_stats(spec, li)).forward(li.select("episode_id", "t", "state", "actions"))
    both = F.array(F.struct(F.lit("state").alias("key"), F.col("state").alias("v")), F.struct(F.lit("actions").alias("key"), F.col("actions")[0].alias("v")))
    e = out.select("episode_id", "t", F.explode(both).alias("e")).select("e.key", "episode_id", "t", F.posexplode("e.v").alias("dim", "value"))
    return e.withColumn("dim", F.col("dim").cast("bigint")).withColumn("value", R6("value"))


@query("contract_check", """SELECT vec_id, true AS image_mask, CAST(len(embedding) AS INTEGER) AS state_len FROM embeddings""")
def q_contract_check(spark, sf_dir):
    """Required columns present, absent mask defaults to all-true."""
    v = views.vectors(spark, sf_dir)
    c = SC.contract_check(v, ["state"], paired={"tokenized_prompt": "tokenized_prompt_mask"}, masks={"image_mask": None})
    return c.select("vec_id", "image_mask", F.size("state").alias("state_len"))


@query("dataset_length", f"""WITH {FRAMES_LI} SELECT count(*) AS n FROM frames_li WHERE t % 3 = 0""")
def q_dataset_length(spark, sf_dir):
    """Dataset length = sum of downsampled episode lengths (from the episode table)."""
    from epiframe.operators import episodes as E

    ep = E.episode_table(E.downsample(views.frames_li(spark, sf_dir), 3))
    return ep.agg(F.sum("length").cast("bigint").alias("n"))



@query("step_id", """SELECT conv_id, turn, 'rec_' || CAST(conv_id AS VARCHAR) || '--' || role || '--' || CAST(turn AS VARCHAR) AS step_id
FROM conversations""")
def q_step_id(spark, sf_dir):
    """Step id from recording folder, file and step index."""
    from epiframe.functions.robots import step_id

    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", step_id(F.concat(F.lit("rec_"), F.col("conv_id").cast("string")), "role",
                                               "turn").alias("step_id"))


@query("camera_roles", """
WITH c AS (SELECT conv_id, turn, role, 'cam_' || CAST(turn AS VARCHAR) AS cam,
                  row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS k FROM conversations),
g AS (SELECT DISTINCT conv_id FROM conversations)
SELECT g.conv_id,
       (SELECT cam FROM c WHERE c.conv_id = g.conv_id AND role = 'user' AND k = 1) AS wrist,
       (SELECT cam FROM c WHERE c.conv_id = g.conv_id AND role <> 'user' AND k = 1) AS exterior_1,
       (SELECT cam FROM c WHERE c.conv_id = g.conv_id AND role <> 'user' AND k = 2) AS exterior_2
FROM g""")
def q_camera_roles(spark, sf_dir):
    """Per episode a camera→role map (user turns = wrist role 0); first wrist, first two exterior."""
    from epiframe.functions.robots import camera_roles

    c = views.table(spark, sf_dir, "conversations")
    entry = F.struct("turn", F.concat(F.lit("cam_"), F.col("turn").cast("string")).alias("cam"),
                     F.when(F.col("role") == "user", 0).otherwise(1).alias("role"))
    ordered = F.array_sort(F.collect_list(entry))
    m = c.groupBy("conv_id").agg(F.map_from_entries(
        F.transform(ordered, lambda x: F.struct(x["cam"], x["role"]))).alias("cams"))
    w, e1, e2 = camera_roles("cams")
    return m.select("conv_id", w.alias("wrist"), e1.alias("exterior_1"), e2.alias("exterior_2"))


@query("selector_map", """
SELECT l_quantity * CAST(2 AS DOUBLE) AS "obs/qty", l_extendedprice AS "obs/price", l_discount * CAST(3 AS DOUBLE) AS action
FROM lineitem""")
def q_selector_map(spark, sf_dir):
    """Apply a function to the leaves named in a selector tree (strict: every selector key must exist)."""
    li = views.table(spark, sf_dir, "lineitem")
    nested = li.select(F.struct(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price")).alias("obs"),
                       F.col("l_discount").alias("action"))
    out = SC.apply_selector(nested, {"obs/qty": 2.0, "action": 3.0}, lambda c, k: c * F.lit(k), strict=True)
    return SC.flatten_struct(out)


@query("filter_success", """
SELECT doc_id FROM labels WHERE regexp_matches('/recordings/' || CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END
                                               || '/episode_' || CAST(doc_id AS VARCHAR) || '.h5', '^.*success.*$')""")
def q_filter_success(spark, sf_dir):
    """Episodes whose recording path contains 'success' (path from the label table)."""
    from epiframe.operators import episodes as E

    lab = views.table(spark, sf_dir, "labels")
    path = F.concat(F.lit("/recordings/"), F.when(F.col("quality") == 1, "success").otherwise("failure"),
                    F.lit("/episode_"), F.col("doc_id").cast("string"), F.lit(".h5"))
    return E.filter_success(lab.select("doc_id", path.alias("file_path"))).select("doc_id")


@query("restructure", f"""WITH {FRAMES_LI}
SELECT episode_id, t, CAST(0 AS BIGINT) AS dim, floor(s0 * 1000000 + CAST('0.49997' AS DOUBLE)) / 1000000 AS value FROM frames_li
UNION ALL SELECT episode_id, t, CAST(1 AS BIGINT), floor(s1 / CAST(1000 AS DOUBLE) * 1000000 + CAST('0.49997' AS DOUBLE)) / 1000000 FROM frames_li
UNION ALL SELECT episode_id, t, CAST(2 AS BIGINT), floor(s3 * 1000000 + CAST('0.49997' AS DOUBLE)) / 1000000 FROM frames_li""")
def q_restructure(spark, sf_dir):
    """Joint-position action space (qty, price/1000) ++ gripper (tax)."""
    from epiframe.operators import episodes as E

    li = views.frames_li(spark, sf_dir)
    s = F.col("state")
    li = li.select("episode_id", "t", F.array(s[0], s[1] / F.lit(1000.0)).alias("joint_position"),
                   F.array(s[2], s[3]).alias("joint_velocity"), F.array(s[3]).alias("gripper_position"))
    return _long_vec(E.restructure(li, "joint_position"), "actions")


# ---------------------------------------------------------------- K2, K5, K6, M11, F2, F4
@query("resume_write", f"""WITH {FRAMES_EV} SELECT episode_id, t, event_id FROM frames_ev""")
def q_resume_write(spark, sf_dir):
    """K2: half of the episodes written and committed, then all of them: every frame is there once."""
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", "event_id")
    out = WR.Resumable(spark, scratch(spark, "resume"))
    out.write(f.filter("episode_id % 2 = 0"), batches=2)
    out.write(f, batches=2, sort_within=["episode_id", "t"])
    return out.read()


@query("records_roundtrip", f"""WITH {FRAMES_EV}
SELECT episode_id, t, {r6('s0')} AS s0, {r6('s1')} AS s1, task AS prompt, {r6("s0 * CAST(2 AS DOUBLE)")} AS a0 FROM frames_ev""")
def q_records_roundtrip(spark, sf_dir):
    """K5: nested records to flat a/b/c columns in files and back."""
    f = views.frames_ev(spark, sf_dir)
    rec = f.select(F.struct("episode_id", "t").alias("step"), F.struct("state", F.struct(F.col("task").alias("prompt")).alias("text")).alias("inputs"),
                   F.struct(F.transform("state", lambda x: x * 2.0).alias("actions")).alias("outputs"))
    path = scratch(spark, "records")
    WR.write_records(rec, path)
    b = WR.read_records(spark, path)
    return b.select("step.episode_id", "step.t", R6(F.col("inputs.state")[0]).alias("s0"), R6(F.col("inputs.state")[1]).alias("s1"),
                    F.col("inputs.text.prompt").alias("prompt"), R6(F.col("outputs.actions")[0]).alias("a0"))


@query("report_tables", """SELECT event_type AS metric, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, f.fmt
FROM events, (VALUES ('parquet'), ('csv')) f(fmt) GROUP BY event_type, f.fmt""")
def q_report_tables(spark, sf_dir):
    """K6: a report written as Parquet and as CSV with a header, read back."""
    ev = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
    out = None
    for fmt in ("parquet", "csv"):
        path = scratch(spark, "report")
        WR.write_table(ev, path, fmt)
        back = spark.read.schema("metric string, n long, total long").option("header", "true").format(fmt).load(path)
        back = back.withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("masked_dims", """SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, CAST(embedding[i] AS DOUBLE) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE (i - 1) % 7 < 6 AND i <= 63""")
def q_masked_dims(spark, sf_dir):
    """The dims that a mask of signed run lengths (6, -1, nine times; 0 adds nothing) covers."""
    mask = make_bool_mask(*[6, -1, 0] * 9)
    v = views.vectors(spark, sf_dir).select("vec_id", F.posexplode("state").alias("dim", "value"))
    m = F.array(*[F.lit(b) for b in mask])
    return v.filter(F.coalesce(F.get(m, F.col("dim")), F.lit(False))).withColumn("dim", F.col("dim").cast("bigint"))


@query("pipeline_push", f"""WITH {FRAMES_EV} SELECT episode_id, t, {r6("(s0 + CAST(1 AS DOUBLE)) * CAST(3 AS DOUBLE)")} AS forward, {r6('s0')} AS back,
  'added,scaled' AS did, 'unscaled,subtracted' AS undid FROM frames_ev""")
def q_pipeline_push(spark, sf_dir):
    """user steps in groups; inputs are appended, outputs prepended, so the inverse runs backwards."""
    def step(fn, col, note, name):
        return lambda df: df.withColumn(col, fn(F.col(col))).withColumn(note, F.concat_ws(",", note, F.lit(name)))

    p = Pipeline().push([step(lambda x: x + 1.0, "x", "did", "added")], [step(lambda x: x - 1.0, "x", "undid", "subtracted")])
    p = p.push([step(lambda x: x * 3.0, "x", "did", "scaled")], [step(lambda x: x / 3.0, "x", "undid", "unscaled")])
    f = views.frames_ev(spark, sf_dir).select("episode_id", "t", F.col("state")[0].alias("x"), F.lit(None).cast("string").alias("did"),
                                              F.lit(None).cast("string").alias("undid"))
    made = p.forward(f).withColumn("forward", R6("x"))
    return p.inverse(made).select("episode_id", "t", "forward", R6("x").alias("back"), "did", "undid")


@query("map_batches", f"""SELECT vec_id, {r6("sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))")} AS norm FROM embeddings""")
def q_map_batches(spark, sf_dir):
    """a function on whole batches of rows."""
    import numpy as np

    def norms(pdf):
        x = np.stack(pdf["state"].to_numpy())
        return pdf[["vec_id"]].assign(norm=np.sqrt((x * x).sum(axis=1)))

    out = map_batches(views.vectors(spark, sf_dir).select("vec_id", "state"), norms, "vec_id long, norm double")
    return out.withColumn("norm", R6("norm"))
