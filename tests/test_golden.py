"""Golden literal cases (behaviour the reference tests, plus edge cases it does not)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.functions import text as TX
from epiframe.functions import vectors as V
from epiframe.functions.hashing import fingerprint
from epiframe.operators import episodes as E
from epiframe.operators import joins as J
from epiframe.operators import ranges as RG
from epiframe.operators import sampling as SM
from epiframe.operators import schema as SC
from epiframe.operators import stats as S
from epiframe.operators import windows as W
from epiframe.sources import discovery as D


def _one(df):
    return df.collect()[0]


# ---------------------------------------------------------------- schema
def test_repack(spark):
    df = spark.sql("select named_struct('c', 1) as b, named_struct('f', 2) as e")
    out = SC.repack(df, {"a": {"b": "b/c"}, "d": "e/f"})
    r = _one(out)
    assert r["a"]["b"] == 1 and r["d"] == 2 and out.columns == ["a", "d"]


def test_repack_missing_path_fails(spark):
    df = spark.sql("select 1 as a")
    with pytest.raises(KeyError):
        SC.repack(df, {"x": "nope"})


def test_regex_rename_and_drop(spark):
    df = spark.sql("select named_struct('b', 1, 'c', 2) as a")
    r = _one(SC.regex_rename(df, {"a/b": "a/c", "a/c": None}))
    assert r.asDict(recursive=True) == {"a": {"c": 1}}


def test_regex_rename_collision(spark):
    df = spark.sql("select named_struct('b', 1, 'c', 2) as a")
    with pytest.raises(ValueError, match="already exists"):
        SC.regex_rename(df, {"a/b": "a/c"})


def test_regex_full_match_only(spark):
    df = spark.sql("select named_struct('b', 1, 'c', 2) as a")
    assert _one(SC.regex_rename(df, {"a": None})).asDict(recursive=True) == {"a": {"b": 1, "c": 2}}
    assert SC.regex_rename(df, {"a.+": None}).columns == []


def test_regex_back_reference(spark):
    df = spark.sql("select named_struct('b', 1, 'c', 1) as a, named_struct('c', 2) as b")
    r = _one(SC.regex_rename(df, {"(.+)/c": r"\1/d"})).asDict(recursive=True)
    assert r == {"a": {"b": 1, "d": 1}, "b": {"d": 2}}


def test_flatten_unflatten_roundtrip(spark):
    df = spark.sql("select named_struct('x', named_struct('y', 1), 'z', 'q') as a, 3 as b")
    flat = SC.flatten_struct(df)
    assert flat.columns == ["a/x/y", "a/z", "b"]
    assert _one(SC.unflatten_struct(flat)).asDict(recursive=True) == _one(df).asDict(recursive=True)


# ---------------------------------------------------------------- vectors
def test_delta_and_absolute(spark):
    df = spark.sql("select array(1d, 2d, 3d) as state, array(array(3d, 4d, 5d), array(5d, 6d, 7d)) as actions")
    d = _one(df.select(V.delta_actions("actions", "state", [False, True]).alias("a")))["a"]
    assert d == [[3, 2, 5], [5, 4, 7]]
    a = _one(df.select(V.absolute_actions("actions", "state", [False, True]).alias("a")))["a"]
    assert a == [[3, 6, 5], [5, 8, 7]]
    assert _one(df.select(V.delta_actions("actions", "state", None).alias("a")))["a"] == [[3, 4, 5], [5, 6, 7]]


def test_make_bool_mask():
    assert V.make_bool_mask(2, -2, 2) == [True, True, False, False, True, True]
    assert V.make_bool_mask(2, 0, 2) == [True] * 4


def test_discretize_edges(spark):
    df = spark.sql("select array(-1.0001d, -1d, 0.9921875d, 1d, 7d, double('NaN')) as x")
    assert _one(df.select(V.discretize("x").alias("b")))["b"] == [-1, 0, 255, 255, 255, 255]


def test_pad_to_dim(spark):
    df = spark.sql("select array(1d, 2d) as x")
    assert _one(df.select(V.pad_to_dim("x", 4).alias("p")))["p"] == [1, 2, 0, 0]
    assert _one(df.select(V.pad_to_dim("x", 1).alias("p")))["p"] == [1, 2]


def test_normalize_inverse_roundtrip(spark):
    df = spark.sql("select array(1d, -2d, 3d) as x")
    m, s = [0.5, 1.0, -1.0], [2.0, 0.5, 3.0]
    n = V.normalize_z("x", m, s)
    back = _one(df.select(V.unnormalize_z(n, m, s).alias("b")))["b"]
    assert np.allclose(back, [1, -2, 3])
    q = V.normalize_q("x", [0.0, -3.0, 0.0], [2.0, 3.0, 4.0])
    back = _one(df.select(V.unnormalize_q(q, [0.0, -3.0, 0.0], [2.0, 3.0, 4.0]).alias("b")))["b"]
    assert np.allclose(back, [1, -2, 3])


def test_unnormalize_quantile_passes_extra_dims(spark):
    df = spark.sql("select array(0d, 0d, 9d) as x")
    out = _one(df.select(V.unnormalize_q("x", [0.0, 0.0], [2.0, 2.0]).alias("b")))["b"]
    assert out[2] == 9 and np.isclose(out[0], 1.0 + 0.5e-6)


# ---------------------------------------------------------------- stats
def test_stats_match_numpy(spark):
    arr = np.arange(12).reshape(4, 3).astype(float)
    df = spark.createDataFrame([(r.tolist(),) for r in arr], "state array<double>")
    st = {(r.key, r.dim): r for r in S.norm_stats(S.long_values(df, ["state"])).collect()}
    for d in range(3):
        assert math.isclose(st[("state", d)]["mean"], arr[:, d].mean())
        assert math.isclose(st[("state", d)]["std"], arr[:, d].std())
        assert st[("state", d)]["count"] == 4


def test_stats_quantiles_histogram_semantics(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(2000)
    df = spark.createDataFrame([([float(v)],) for v in x], "state array<double>")
    st = _one(S.norm_stats(S.long_values(df, ["state"])))
    lo, hi = x.min() - 1e-10, x.max() + 1e-10
    edges = np.linspace(lo, hi, 5001)
    hist, _ = np.histogram(x, bins=edges)
    cum = np.cumsum(hist)
    for q, name in ((0.01, "q01"), (0.99, "q99")):
        expect = edges[np.searchsorted(cum, q * len(x))]
        assert abs(st[name] - expect) <= (hi - lo) / 5000 + 1e-12


def test_stats_constant_column(spark):
    df = spark.createDataFrame([([5.0],)] * 10, "state array<double>")
    st = _one(S.norm_stats(S.long_values(df, ["state"])))
    assert st["std"] == 0 and abs(st["q01"] - 5.0) < 1e-9 and abs(st["q99"] - 5.0) < 1e-9


def test_stats_fewer_than_two_fails(spark):
    df = spark.createDataFrame([([5.0],)], "state array<double>")
    with pytest.raises(Exception, match="less than 2"):
        S.norm_stats(S.long_values(df, ["state"])).collect()


def test_stats_json_roundtrip(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([4.0, 0.0],)], "state array<double>")
    st = S.norm_stats(S.long_values(df, ["state"]))
    back = S.stats_from_json(S.stats_json(st))
    a = sorted((r.key, r.dim, r.mean, r.std, r.q01, r.q99) for r in st.collect())
    b = sorted((r.key, r.dim, r.mean, r.std, r.q01, r.q99) for r in back.collect())
    assert a == b


# ---------------------------------------------------------------- joins, discovery
def test_task_prompt(spark):
    tasks = spark.createDataFrame([(1, "Hello, world!")], "task_index int, task string")
    ok = spark.createDataFrame([(1,)], "task_index int")
    assert _one(J.join_task_prompt(ok, tasks))["prompt"] == "Hello, world!"
    bad = spark.createDataFrame([(2,)], "task_index int")
    with pytest.raises(Exception, match="unknown task index"):
        J.join_task_prompt(bad, tasks).collect()
    with pytest.raises(KeyError):
        J.join_task_prompt(spark.createDataFrame([(1,)], "x int"), tasks)


def test_discovery_complete_only(spark):
    keys = [("b", "ep1/raw_video/cam_high.mp4"), ("b", "ep1/raw_video/cam_left_wrist.mp4"),
            ("b", "ep1/raw_video/cam_right_wrist.mp4"), ("b", "ep2/raw_video/cam_high.mp4"),
            ("b", "ep2/raw_video/cam_left_wrist.mp4")]
    listing = spark.createDataFrame(keys, "bucket string, key string")
    assert [tuple(r) for r in D.discover_multiview(listing).collect()] == [("b", "ep1/")]
    miss = _one(D.missing_views(listing))
    assert miss["prefix"] == "ep2/" and miss["missing"] == ["cam_right_wrist"]


def test_fingerprint_changes_with_flag(spark):
    df = spark.sql("select 'bucket/ep1/' as k")
    a = _one(df.select(fingerprint("k", multi_view=True).alias("f")))["f"]
    b = _one(df.select(fingerprint("k", multi_view=False).alias("f")))["f"]
    assert a != b


def test_uri_split(spark):
    df = spark.sql("select 's3://bkt/a/b.mp4' as u, 's3+write://bkt2' as v")
    b, k = D.uri_split("u")
    b2, k2 = D.uri_split("v")
    r = _one(df.select(b, k, b2, k2))
    assert tuple(r) == ("bkt", "a/b.mp4", "bkt2", "")


# ---------------------------------------------------------------- batching, mixture, replay
def test_batches_and_epoch_loop(spark):
    df = spark.range(16).withColumnRenamed("id", "pos")
    out = SM.epoch_loop(df, 4, 2)
    assert sorted(r.batch for r in out.select("batch").distinct().collect()) == [0, 1]
    assert out.count() == 8
    small = spark.range(4).withColumnRenamed("id", "pos")
    out = SM.epoch_loop(small, 4, 10)
    assert out.select("batch").distinct().count() == 10 and out.count() == 40
    with pytest.raises(Exception, match="3 rows, fewer than batch size 4"):
        SM.batch_rows(spark.range(3).withColumnRenamed("id", "pos"), 4).collect()


def test_mixture_weights(spark):
    a = spark.range(100).withColumnRenamed("id", "k")
    b = spark.range(5).withColumnRenamed("id", "k")
    out = SM.weighted_mix(spark, {"a": a, "b": b}, {"a": 0.9, "b": 0.1}, 20000, ["k"], seed=1)
    frac = out.filter(F.col("source") == "a").count() / 20000
    assert abs(frac - 0.9) < 0.01
    assert out.filter(F.col("source") == "b").select("k").distinct().count() == 5  # small source repeats
    with pytest.raises(ValueError):
        SM.weighted_mix(spark, {"a": a, "b": b}, {"a": 0.9, "b": 0.2}, 10, ["k"])


def test_chunk_replay_each_step_one_action(spark):
    h = 4
    steps = spark.range(8).select(F.lit(1).cast("bigint").alias("episode_id"), F.col("id").alias("t"))
    plans = steps.filter(F.col("t") % h == 0).withColumn(
        "chunk", F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: (F.col("t") * 10 + i).cast("double")))
    out = {r.t: r.action for r in W.chunk_replay(steps, plans, h).collect()}
    assert out == {t: float((t // h) * h * 10 + t % h) for t in range(8)}
    asof = {r.t: r.action for r in W.asof_replay(steps, plans).collect()}
    assert asof == out


def test_resume_anti_join(spark):
    todo = spark.range(5).withColumnRenamed("id", "episode_id")
    done = spark.range(3).withColumnRenamed("id", "episode_id")
    assert sorted(r.episode_id for r in RG.resume_anti_join(todo, done).collect()) == [3, 4]


# ---------------------------------------------------------------- idle ranges
def _idle_frames(spark, series):
    rows = [(1, t, [float(v)]) for t, v in enumerate(series)]
    return spark.createDataFrame(rows, "episode_id long, t long, vel array<double>")


def test_idle_runs_six_and_seven(spark):
    # 20 moving frames, 6 idle (kept), 20 moving, 7 idle (removed), 20 moving
    series, v = [], 0.0
    for n_move, n_idle in ((20, 6), (20, 7), (20, 0)):
        for _ in range(n_move):
            v += 1.0
            series.append(v)
        series += [v] * n_idle
    r = RG.nonidle_ranges(_idle_frames(spark, series), "vel").orderBy("start").collect()
    # keep: [0, 46) (20+6+20 frames, the idle frames are t=20..25 and t=46..52) then [53, 73)
    assert [(x.start, x.end) for x in r] == [(0, 46 - 10), (53, 73 - 10)]


def test_keep_runs_fifteen_and_sixteen(spark):
    series, v = [], 0.0
    for n_move in (15, 16):
        for _ in range(n_move):
            v += 1.0
            series.append(v)
        series += [v] * 7
    r = RG.nonidle_ranges(_idle_frames(spark, series), "vel").collect()
    # first run t=0..14 (15 frames incl. the first) dropped; second run t=22..37 (16) kept
    assert [(x.start, x.end) for x in r] == [(22, 38 - 10)]


def test_whole_episode_idle(spark):
    r = RG.nonidle_ranges(_idle_frames(spark, [1.0] * 30), "vel").collect()
    assert len(r) == 1 and r[0].start is None


def test_idle_threshold_strict(spark):
    fl = RG.idle_flag(_idle_frames(spark, [0.0, 0.001, 0.0015]), "vel").orderBy("t").collect()
    assert [x.idle for x in fl] == [False, False, True]


def test_range_semi_join_edges(spark):
    frames = spark.range(10).select(F.lit(1).cast("bigint").alias("episode_id"), F.col("id").alias("t")).unionByName(
        spark.range(3).select(F.lit(2).cast("bigint").alias("episode_id"), F.col("id").alias("t")))
    ranges = spark.createDataFrame([(1, 2, 4), (1, 4, 6)], "episode_id long, start long, end long")
    for exploded in (False, True):
        kept = sorted((r.episode_id, r.t) for r in RG.range_semi_join(frames, ranges, exploded=exploded).collect())
        assert kept == [(1, 2), (1, 3), (1, 4), (1, 5)]  # touching ranges; unknown episode 2 dropped
    assert RG.range_semi_join(frames, None).count() == 13
    empty = spark.createDataFrame([], "episode_id long, start long, end long")
    assert RG.range_semi_join(frames, empty).count() == 0


# ---------------------------------------------------------------- text
def test_text_cleaning_and_extraction(spark):
    df = spark.sql("select '  Pick_up the\\ncup \\t' as p, 'x Action: 1 2 3 | rest' as a, 'nothing' as b")
    r = _one(df.select(TX.clean_prompt_a("p").alias("ca"), TX.clean_prompt_b("p").alias("cb"),
                       TX.extract_action_text("a").alias("ea"), TX.extract_action_text("b").alias("eb")))
    assert r.ca == "Pick up the cup" and r.cb == "pick up the\ncup" and r.ea == "1 2 3" and r.eb == ""


def test_pad_tokens_and_masks(spark):
    df = spark.sql("select array(5, 6, 7) as t")
    tok, mask, trunc = TX.pad_tokens("t", 5)
    r = _one(df.select(tok.alias("t"), mask.alias("m"), trunc.alias("x")))
    assert r.t == [5, 6, 7, 0, 0] and r.m == [True, True, True, False, False] and not r.x
    tok, mask, trunc = TX.pad_tokens("t", 2)
    r = _one(df.select(tok.alias("t"), mask.alias("m"), trunc.alias("x")))
    assert r.t == [5, 6] and r.m == [True, True] and r.x
    tm, ar, loss = TX.prefix_masks(F.lit(2), F.lit(1), 5)
    r = _one(df.select(tm.alias("tm"), ar.alias("ar"), loss.alias("l")))
    assert r.tm == [True, True, True, False, False] and r.ar == [0, 0, 1, 0, 0] and r.l == [False, False, True, False, False]


def test_min_length_and_truncate(spark):
    frames = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False)],
                                   "episode_id long, t long, failed boolean")
    assert sorted(r.t for r in E.truncate_on_failure(frames, "failed").filter("episode_id = 1").collect()) == [0]
    assert [r.episode_id for r in E.min_length(frames, 2).select("episode_id").distinct().collect()] == [1]


def test_pipeline_order_and_batch_step(spark):
    from epiframe.plans.pipeline import Pipeline, map_batches

    calls = []

    def step(name):
        def run(df):
            calls.append(name)
            return df
        return run

    p = Pipeline().push(inputs=[step("a")], outputs=[step("A")]).push(inputs=[step("b")], outputs=[step("B")])
    df = spark.range(10)
    p.forward(df)
    p.inverse(df)
    assert calls == ["a", "b", "B", "A"]  # outputs are prepended: inverse runs in reverse
    out = map_batches(df, lambda pdf: pdf.assign(y=pdf["id"] * 2), "id long, y long")
    assert sorted((r.id, r.y) for r in out.collect()) == [(i, 2 * i) for i in range(10)]


def test_running_best(spark):
    steps = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0)], "episode_id long, t long, reward double")
    assert [r.best_so_far for r in E.running_best(steps).orderBy("t").collect()] == [1.0, 3.0, 3.0]


def test_eval_pairs_within_episode_and_strict_reference(spark):
    from epiframe.operators import evaluation as EV

    frames = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 1, 1, [2.0]), (2, 0, 2, [5.0]), (2, 1, 3, [6.0])],
                                   "episode_id long, t long, gidx long, state array<double>")
    inside = sorted((r.episode_id, r.t, r.next_state[0]) for r in EV.eval_pairs(frames, ["state"]).collect())
    assert inside == [(1, 0, 2.0), (2, 0, 6.0)]  # the last frame of an episode has no partner
    strict = sorted((r.gidx, r.next_state[0]) for r in EV.eval_pairs(frames, ["state"], strict_reference=True).collect())
    assert strict == [(0, 2.0), (1, 5.0), (2, 6.0)]  # idx + 1 crosses into the next episode
