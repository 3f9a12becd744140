"""Work that must not be done twice: once a row in vector steps, one shuffle of whole rows in orderings and stacking."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from epiframe.functions import vectors as V
from epiframe.operators import episodes as E
from epiframe.operators import stats as S
from epiframe.plans import ordered as O
from epiframe.plans import queries_recipes as Q
from epiframe.plans import recipes as RC
from epiframe.plans.queries_core import _long_vec


@contextlib.contextmanager
def _conf(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _filters(df) -> list[str]:
    return [line for line in _optimized(df).split("\n") if line.lstrip(" :+-").startswith("Filter")]


def _frames(spark, dims: int):
    rows = [(e, t, [0.5 * t + 0.01 * j + e for j in range(dims)]) for e in (1, 2) for t in range(5)]
    f = spark.createDataFrame(rows, "episode_id long, t long, state array<double>")
    return f.withColumns({"cam_high": F.array(F.lit(1)), "cam_left_wrist": F.array(F.lit(2)),
                          "actions": F.transform("state", lambda x: x * 2.0 - 0.1)})


@pytest.mark.parametrize("name, fn", [
    ("absolute", lambda: V.absolute_actions("rows", "s", [True, False])),
    ("delta", lambda: V.delta_actions("rows", "s", [True, False])),
])
def test_vector_step_computes_its_inputs_outside_its_own_lambdas(spark, name, fn):
    df = spark.createDataFrame([([4.0, 9.0], [[1.0, 2.0], [3.0, 4.0]])], "x array<double>, rows array<array<double>>")
    out = df.withColumn("s", F.transform("x", F.sqrt)).select(fn().alias("y"))
    assert _optimized(out).split("SQRT")[0].count("lambdafunction(") == 1  # only its own lambda is around the root
    want = {"absolute": [[3.0, 2.0], [5.0, 4.0]], "delta": [[-1.0, 2.0], [1.0, 4.0]]}
    assert out.first()["y"] == want[name]


def test_inverse_of_a_recipe_is_computed_once_a_row(spark):
    r = RC.recipe("arm31", horizon=2)
    frames = _frames(spark, 31)
    pipe = RC.build_recipe(r, RC.recipe_stats(r, frames))
    made = pipe.forward(frames)
    back, forward = Q._inverse_rows(pipe.inverse(made), 31), Q._forward_rows(made, 32)
    for df in (back, forward):
        assert not [f for f in _filters(df) if "transform(" in f]
    want = {(r["episode_id"], r["t"]): r["actions"] for r in frames.collect()}
    rows = back.collect()
    assert len(rows) == 20
    for r in rows:
        assert [r[f"d{j}"] for j in range(31)] == pytest.approx(want[r["episode_id"], min(r["t"] + r["i"], 4)], abs=2e-6)
    assert sorted(r["i"] for r in forward.collect()) == [-1] * 10 + [0] * 10 + [1] * 10


def test_normalised_vectors_are_listed_without_a_second_computation(spark):
    f = _frames(spark, 2).select("episode_id", "t", "state")
    st = S.norm_stats(S.long_values(f, ["state"]))
    both = S.apply_stats(S.apply_stats(f, st, {"state": "state"}, "quantile"), st, {"state": "state"}, "quantile", inverse=True)
    out = _long_vec(both, "state")
    assert not [x for x in _filters(out) if "transform(" in x]
    assert out.count() == 20


def test_numbering_deals_whole_rows_out_once(spark):
    rows = [(k, v, f"text {v}") for k in (1, None, 2) for v in range(0, 40_000, 1_000)]
    df = spark.createDataFrame(rows, "k long, v long, s string")
    with _conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        for out in (O.index_within(df, ["k"], ["v"], "n"), O.running_agg(df, F.lit(1), ["v"], "n", ["k"]),
                    O.index_within(df, ["s"], ["v"], "n")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            whole = [p for p in plan.split("\n") if "hashpartitioning(" in p and "_block#" in p and "_range#" not in p]
            assert len(whole) == 2, plan  # the rows, and the small table of blocks to join
        got = O.index_within(df, ["k"], ["v"], "n")
        assert got.columns == ["k", "v", "s", "n"]
        assert sorted((str(r["k"]), r["v"], r["n"]) for r in got.collect()) == sorted((str(k), v, v // 1_000) for k, v, _ in rows)


def test_modalities_are_dealt_out_as_they_are(spark):
    tables = {m: spark.createDataFrame([(1, t, [float(t + 10 * i)] * 9) for t in range(3 if m != "head" else 2)] + [(None, 0, [float(i)] * 9)],
                                       "episode_id long, t long, v array<double>")
              for i, m in enumerate(("eef_torso", "head", "eef_left", "gripper_cmd", "eef_right"))}
    with _conf(spark, spark__sql__adaptive__enabled="false"):
        out = E.modality_concat(tables)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        below = plan.split("Exchange hashpartitioning")[1]
        assert "Aggregate" not in below and "Sort" not in below
    got = {(r["episode_id"], r["t"]): r["state"] for r in out.collect()}
    assert set(got) == {(1, 0), (1, 1), (None, 0)}
    assert got[None, 0] == [0.0] * 9 + [1.0] * 2 + [2.0] * 9 + [3.0] + [4.0] * 9 + [3.0]
