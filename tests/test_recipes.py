"""Recipes forward and back, views and masks, and statistics on vector columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.functions import robots as RB
from epiframe.functions import vectors as V
from epiframe.operators import stats as S
from epiframe.operators import vector_stats as VS
from epiframe.operators import windows as W
from epiframe.plans import recipes as RC
from epiframe.sources import views
from tests.conftest import SF001


def _chunks(df):
    return {(r["episode_id"], r["t"]): np.array(r["actions"]) for r in df.collect()}


@pytest.mark.parametrize("name,dims", [("dual_arm", 14), ("arm7_delta", 7), ("arm31", 31)])
def test_inverse_returns_the_robots_chunks(spark, name, dims):
    fields = {"state": "state", "actions": "actions", "prompt": "prompt"} | ({"cam_high": "cam_high"} if name != "arm7_delta" else {})
    r = RC.recipe(name, horizon=3, fields=fields, actions="actions")
    f = views.arm_frames(spark, SF001, dims).filter("episode_id < 6")
    pipe = RC.build_recipe(r, RC.recipe_stats(r, f))
    got = _chunks(pipe.inverse(pipe.forward(f)))
    want = _chunks(W.action_chunk(f, 3))
    assert got.keys() == want.keys() and len(got)
    assert all(np.allclose(got[k], want[k], atol=1e-9) and got[k].shape == (3, dims) for k in got)


def test_arm31_query_goes_back_over_the_whole_horizon(spark, tmp_path):
    """Every frame's answer has the preset's 50 rows, each the action so many frames on, the last one kept."""
    import __spark_entry__ as entry

    n = {1: 70, 2: 3}
    rows = [(100 * u + t, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", u, "view", 10.0 * u + t, f'{{"k": {t % 7}}}') for u in n for t in range(n[u])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["episode_id"], r["t"], r["i"]): r for r in entry.queries()["recipe_arm31_inverse"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(u, t, i) for u in n for t in range(n[u]) for i in range(50)}
    for (u, t, i), r in got.items():
        at = min(t + i, n[u] - 1)
        assert r["d0"] == pytest.approx((10.0 * u + at) / 500 - 0.1, abs=1e-6) and r["d1"] == pytest.approx((at % 7 / 1000 - 0.01) * 2 - 0.1, abs=1e-6)


def test_inference_rows_have_no_actions(spark):
    r = RC.recipe("arm7_delta", horizon=3, fields={"state": "state", "actions": "actions", "prompt": "prompt"})
    f = views.arm_frames(spark, SF001, 7).filter("episode_id < 4")
    pipe = RC.build_recipe(r, RC.recipe_stats(r, f))
    seen = pipe.forward(f.drop("actions"))
    assert "actions" not in seen.columns
    answer = seen.withColumn("actions", F.array(*[F.array_repeat(F.lit(0.0), 32) for _ in range(3)]))
    rows = pipe.inverse(answer).collect()
    st = {(x["key"], x["dim"]): x["mean"] for x in RC.recipe_stats(r, f).collect()}
    state = {(x["episode_id"], x["t"]): x["state"] for x in f.collect()}
    for x in rows:  # a zero z-score is the mean, on top of the state where the recipe takes deltas
        want = [st[("actions", d)] + (state[(x["episode_id"], x["t"])][d] if d < 6 else 0.0) for d in range(7)]
        assert np.allclose(x["actions"][0], want, atol=1e-9)


def test_token_family_answers(spark):
    r = RC.recipe("arm7", horizon=2, dims=2)
    ids = [ord(c) for c in "Task: x;\nAction: "]
    rows = [(1, [*ids, *[r.vocabulary - 129 - b for b in (0, 128, 255, 64)], ord("|"), 0]), (2, [*ids, 5]), (3, [7, 7]), (4, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<int>")
    got = {x["id"]: x["actions"] for x in RC.FAMILIES["tokens"](r).inverse(df).collect()}
    assert got[1] == [[-1.0, 0.0], [255 / 128 - 1, -0.5]]
    assert got[2] == got[3] == got[4] == [[0.0, 0.0], [0.0, 0.0]]


def test_unknown_views_and_families(spark):
    df = spark.createDataFrame([([0.0] * 14, [1], [2])], "state array<double>, cam_high array<int>, cam_back array<int>")
    with pytest.raises(ValueError, match="cam_back"):
        RB.map_dual_arm_in(df)
    with pytest.raises(ValueError, match="unknown model family"):
        RC.build_recipe(RC.recipe("arm7", family="other"), None)
    with pytest.raises(KeyError, match="exterior_image"):
        RC.data_side(RC.recipe("arm8", keys=("state", "cam_high"))).forward(df)


def test_missing_views_are_black(spark):
    df = spark.createDataFrame([(1, b"\x05\x06\x07", None), (2, b"\x01", b"\x09")], "id int, image binary, wrist_image binary")
    got = {r["id"]: r for r in RB.map_arm7_in(df).collect()}
    assert got[1]["image"]["left_wrist_0_rgb"] == b"\0\0\0" and got[2]["image"]["left_wrist_0_rgb"] == b"\x09"
    assert got[2]["image"]["right_wrist_0_rgb"] == b"\0" and got[1]["image_mask"] == {"base_0_rgb": True, "left_wrist_0_rgb": True, "right_wrist_0_rgb": False}


# ---------------------------------------------------------------- statistics on vectors
def test_chunk_stats_equal_exploded_chunks(spark, small_blocks):
    f = views.arm_frames(spark, SF001, 4).withColumn("episode_id", F.when(F.col("episode_id") > 3, F.col("episode_id")))
    from epiframe.plans.ordered import index_within

    f = index_within(f.drop("t"), ["episode_id"], ["state", "prompt"], out="t")
    f = f.withColumn("actions", F.when(F.col("t") % 11 != 5, F.col("actions")))  # missing vectors
    mask = V.make_bool_mask(2, -1)
    got = {(r["key"], r["dim"]): r for r in VS.chunk_stats(f.repartition(5), 5, mask).collect()}
    ch = W.action_chunk(f, 5).withColumn("actions", V.delta_actions("actions", "state", mask))
    want = {(r["key"], r["dim"]): r for r in S.norm_stats(S.long_values(ch, ["state"], ["actions"])).collect()}
    assert got.keys() == want.keys() and len(got) == 8
    for k, w in want.items():
        g = got[k]
        assert g["count"] == w["count"] and g["min"] == pytest.approx(w["min"]) and g["max"] == pytest.approx(w["max"])
        assert all(g[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9) for c in ("mean", "std", "q01", "q99"))


def test_growing_histograms_merge_exactly():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(4000) * 10.0 ** rng.integers(-6, 9, 4000)
    one, h, seen = VS.Growing(5000), VS.Growing(5000), []
    one.add(x, x.min(), x.max())
    for part in np.array_split(np.sort(np.abs(x)) * np.sign(x), 40):
        seen = np.concatenate([seen, part])
        h.add(part, seen.min(), seen.max())
    y = VS.Growing(5000)
    y.add(seen, seen.min(), seen.max())
    assert (h.e, h.base, h.counts.tolist()) == (y.e, y.base, y.counts.tolist()) and len(h.counts) <= 5000
    assert one.counts.sum() == 4000


@pytest.mark.parametrize("low,high", [(0.0, 0.0), (5.0, 5.0), (-1e12, 1e12), (0.1, 0.1 + 1e-13), (-3.0, 4096.0), (1e-30, 2e-30), (123456789.0, 123456790.0)])
def test_bin_exponents_agree(spark, low, high):
    want = VS.bin_exponent(low, high)
    got = spark.range(1).select(VS.bin_exponent_col(F.lit(low), F.lit(high)).alias("e")).first()["e"]
    assert got == want


def test_vector_stats_of_odd_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0],), (None,), ([],), ([None, float("nan")],), ([float("inf"), 4.0],)], "v array<double>")
    got = {r["dim"]: (r["count"], r["mean"], r["min"], r["max"]) for r in VS.growing_stats(df, {"v": "v"}).collect()}
    assert got == {0: (2, 2.0, 1.0, 3.0), 1: (2, 3.0, 2.0, 4.0)}
    assert VS.growing_stats(df.limit(0), {"v": "v"}).count() == 0
    with pytest.raises(ValueError, match="less than 2"):
        one = spark.createDataFrame([(1, 0, [1.0], [2.0])], "episode_id long, t long, state array<double>, actions array<double>")
        VS.chunk_stats(one, 2, None)
