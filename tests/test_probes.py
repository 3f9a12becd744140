"""Legal inputs that once gave wrong answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from epiframe.functions import robots, text
from epiframe.functions import vectors as V
from epiframe.operators import joins as J
from epiframe.operators import stats as S
from epiframe.operators import windows as W
from epiframe.sources import readers as RD


def test_unknown_asset_fails_when_its_stats_are_read(spark):
    frames = spark.createDataFrame([(1, 7), (2, 99)], "id int, asset_id int")
    cat = spark.createDataFrame([(7, [1.0, 2.0])], "asset_id int, mean array<double>")
    ok = J.stats_catalogue(frames.filter("id = 1"), cat).collect()[0]
    assert ok.stats.mean == [1.0, 2.0]
    with pytest.raises(Exception, match="no norm stats for asset 99"):
        J.stats_catalogue(frames, cat).select("id", "stats.mean").collect()


@pytest.mark.parametrize("column", ["count", "mean", "std", "min", "max", "q01", "q99"])
def test_one_vector_is_too_few_for_every_statistic(spark, column):
    values = S.long_values(spark.createDataFrame([([1.0, 2.0],)], "state array<double>"), ["state"])
    with pytest.raises(Exception, match="less than 2"):
        S.norm_stats(values).select(column).collect()


def test_discretize_extremes(spark):
    df = spark.createDataFrame([([math.inf, -math.inf, 1e300, -1e300, 3e7, math.nan, 0.0, -1.0, 1.0],)], "x array<double>")
    assert df.select(V.discretize("x")).collect()[0][0] == [255, -1, 255, -1, 255, 255, 128, 0, 255]


def test_strip_equals_python(spark):
    texts = ["  a ", "\x1f\x1c b \x85", "　c​", " d  e\n", "", " \t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.strip_ws("t")).collect()] == [t.strip() for t in texts]


def test_null_action_is_an_action(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (1, 1, None), (1, 2, [3.0])], "episode_id long, t long, actions array<double>")
    got = {r.t: r.actions for r in W.action_chunk(df, 3).collect()}
    assert got == {0: [[1.0], None, [3.0]], 1: [None, [3.0], [3.0]], 2: [[3.0], [3.0], [3.0]]}


def test_short_or_missing_stats_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0], [0.0, 0.0], None)], "x array<double>, a array<double>, b array<double>, n array<double>")
    for expr in (V.normalize_z("x", "a", "b"), V.normalize_q("x", "n", "b"), V.normalize_q("x", "b", "a")):
        with pytest.raises(Exception, match="missing or shorter"):
            df.select(expr).collect()
    assert df.select(V.normalize_z("n", "a", "b")).collect()[0][0] is None
    longer = df.select(V.normalize_z("a", "b", F.array(F.lit(1.0), F.lit(1.0)))).collect()[0][0]
    assert longer == [0.0]


def test_records_of_two_episodes_stay_apart(spark):
    df = spark.createDataFrame([(0, 10_000, [1.0]), (1, 0, [2.0])], "episode_id long, t long, v array<double>")
    got = {(r.episode_id, r.t): r.x for r in RD.records_pivot(df, {"x": "v"}, ["episode_id", "t"]).collect()}
    assert got == {(0, 10_000): 1.0, (1, 0): 2.0}


def test_unexpected_names(spark):
    assert robots.unexpected_names(["b", "a", "x"], ["a", "b"]) == ["x"]
    rows = robots.unexpected_rows(spark.createDataFrame([("a",), ("x",), (None,), ("x",)], "name string"), "name", ["a"]).collect()
    assert {(r.name, r.n) for r in rows} == {("x", 2), (None, 1)}


def test_checkpoint_folder_comes_from_the_session(spark):
    from epiframe.session import checkpoint_dir

    assert checkpoint_dir(spark)
