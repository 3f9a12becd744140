"""Radix selection: bits of doubles, quantiles against numpy, plan."""

from __future__ import annotations

import contextlib
import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import selection as SE

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def _bits(x: float) -> int:
    own = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -own if x < 0 else own


def test_ordered_bits_are_those_of_the_double(spark):
    edges = [m * 2.0 ** e for e in range(-1074, 1024) for m in (1.0, 1.5)]
    near = [f(v) for v in edges for f in (lambda v: math.nextafter(v, 0.0), lambda v: math.nextafter(v, math.inf))]
    rng = np.random.default_rng(3)
    wide = np.frombuffer(rng.bytes(8 * 4000), dtype=np.float64)
    values = [v for v in [0.0, *edges, *near, *wide[np.isfinite(wide)].tolist()] if math.isfinite(v)]
    values += [-v for v in values]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", SE.ordered_bits(F.col("x")).alias("b")).collect()
    assert all(r.b == _bits(r.x) for r in got)


def test_ordered_bits_of_specials(spark):
    values = [-math.inf, -1.0, -0.0, 0.0, 1.0, math.inf, math.nan]
    got = [r.b for r in spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, x double")
           .orderBy("n").select(SE.ordered_bits(F.col("x")).alias("b")).collect()]
    assert got[2] == got[3] == 0 and got == sorted(got) and got[-1] > got[-2]
    null = spark.sql("select cast(null as double) x").select(SE.ordered_bits(F.col("x")).alias("b")).first()
    assert null.b is None


@pytest.mark.parametrize("few", [True, False])
def test_select_quantiles_match_numpy(spark, few):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=700), "tight": 1.7e9 + rng.random(500) * 1e-3, "ties": rng.integers(0, 4, 600).astype(float),
        "wide": np.exp(rng.normal(size=300) * 200), "one": np.array([3.5]), "two": np.array([-1.0, 2.0]),
        "tiny": rng.random(50) * 1e-310, None: -rng.random(90)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("nulls", None), ("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r.asDict() for r in SE.select_quantiles(df, ["g"], "v", QS, few_groups=few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for q in QS:
            assert got[g][f"p{round(q * 100)}"] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=0), (g, q)


def test_select_quantiles_equal_rank_quantiles(spark):
    from epiframe.operators.stats import exact_quantiles

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    args = (["l_returnflag"], "l_extendedprice", QS)
    a, b = ({r[0]: tuple(r)[1:] for r in f(li, *args).collect()} for f in (SE.select_quantiles, exact_quantiles))
    assert a.keys() == b.keys() and all(a[g] == pytest.approx(b[g]) for g in a)


def test_select_quantiles_without_keys_of_empty_and_nan(spark):
    one = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0)], "v double")
    assert SE.select_quantiles(one, [], "v", [0.5]).first().p50 == 2.5
    empty = spark.createDataFrame([], "g string, v double")
    assert SE.select_quantiles(empty, ["g"], "v", [0.5]).collect() == []
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "v double")
    r = SE.select_quantiles(nan, [], "v", [0.5, 1.0]).first()
    assert r.p50 == 2.0 and math.isnan(r.p100)


def test_only_counts_are_shuffled(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.5).alias("v"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        SE.select_quantiles(df, ["g"], "v", QS, few_groups=True).explain()
    plan = buf.getvalue()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in "".join(semi)
