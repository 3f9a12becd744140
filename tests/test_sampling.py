"""Shuffles without a sort, draws per episode, range sweeps, block orders: against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from epiframe.operators import ranges as RG
from epiframe.operators import sampling as SM
from epiframe.plans.ordered import index_within, running_agg


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 10_007])
def test_dense_shuffle_is_a_bijection(spark, n):
    ids = spark.range(n)
    got = [r["pos"] for r in SM.shuffle_dense(ids, "id", n, seed=3).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    again = [r["pos"] for r in SM.shuffle_dense(ids.repartition(5), "id", ids, seed=3).orderBy("id").collect()]
    assert again == got  # whatever the partitions, and with the count taken in the plan
    if n >= 1000:
        other = [r["pos"] for r in SM.shuffle_dense(ids, "id", n, seed=3, epoch=1).orderBy("id").collect()]
        assert sum(a == b for a, b in zip(got, other)) < n / 50
        assert sum(abs(a - i) for i, a in enumerate(got)) / n == pytest.approx(n / 3, rel=0.1)
        assert sum(b > a for a, b in zip(got, got[1:])) == pytest.approx(n / 2, rel=0.1)


def test_dense_shuffle_needs_no_exchange(spark):
    plan = SM.shuffle_dense(spark.range(1000), "id", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_buffered_shuffle_stays_in_its_run(spark):
    out = SM.shuffle_dense(spark.range(1050), "id", 1050, seed=1, buffer=100).collect()
    assert sorted(r["pos"] for r in out) == list(range(1050))
    assert all(r["pos"] // 100 == r["id"] // 100 for r in out)
    by_run = {}
    for r in out:
        by_run.setdefault(r["id"] // 100, []).append((r["id"] % 100, r["pos"] % 100))
    assert len({tuple(sorted(v)) for k, v in by_run.items() if k < 10}) > 1  # runs differ


@pytest.mark.parametrize("limit", [1000, 3])
def test_draw_filter_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(SM, "_PARTIAL_LIMIT", limit)
    rows = [(e if e else None, t) for e in range(6) for t in range(40 * e + 2)]
    df = spark.createDataFrame(rows, "episode_id long, t long")
    drawn = SM.sample_k_per_episode(df, 4, overdraw=2.0).collect()
    kept = SM.sample_k_per_episode(df, 4, overdraw=2.0, keep=F.col("t") % 3 != 0).collect()
    for e in {r[0] for r in rows}:
        own = [t for x, t in rows if x == e]
        d = [r["t"] for r in drawn if r["episode_id"] == e]
        k = [r["t"] for r in kept if r["episode_id"] == e]
        assert len(d) == min(8, len(own)) and set(d) <= set(own)
        assert len(k) == min(4, sum(t % 3 != 0 for t in d)) and set(k) <= set(d)


def test_sweep_and_coalesce_equal_brute_force(spark, small_blocks):
    rng = random.Random(2)
    ranges = [(e if e else None, s, s + rng.choice([0, 1, 3, 9, 40, 10 ** 9])) for e in range(4) for s in rng.choices(range(200), k=12)]
    frames = [(e if e else None, t, f"x{t}") for e in range(5) for t in range(0, 230, 3)]
    f = spark.createDataFrame(frames, "episode_id long, t long, tag string")
    r = spark.createDataFrame(ranges, "episode_id long, start long, end long")
    got = sorted((tuple(x) for x in RG.range_sweep_join(f, r).collect()), key=str)
    assert got == sorted((x for x in frames if any(e == x[0] and a <= x[1] < b for e, a, b in ranges)), key=str)
    merged = {}
    for x in RG.coalesce_ranges(r).collect():
        merged.setdefault(x["episode_id"], []).append((x["start"], x["end"]))
    for e in {x[0] for x in ranges}:
        own = sorted(merged.get(e, []))
        assert all(b < c for (_, b), (c, _) in zip(own, own[1:]))
        points = [p for x, a, b in ranges if x == e and b > a for p in (a, b - 1, b)]
        for p in points:
            assert any(a <= p < b for a, b in own) == any(x == e and a <= p < b for x, a, b in ranges)


@pytest.mark.parametrize("values", [
    ["https://example.org/" + "a" * (i % 5) + str(i) for i in range(300)], [f"same-prefix-{i % 7}" for i in range(100)], ["", "é", "ê", "日本", "z", None],
    [i / 1000 for i in range(400)], [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 5e-324, 1.0, None]])
def test_orders_of_all_values(spark, small_blocks, values):
    kind = "double" if isinstance(values[0], float) else "string"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}").repartition(4)
    got = [r["id"] for r in index_within(df, [], ["v", "id"], out="k").orderBy("k").collect()]
    assert got == [r["id"] for r in df.orderBy("v", "id").collect()]
    ones = running_agg(df.withColumn("one", F.lit(1)), "one", ["v", "id"], "upto").orderBy("upto").collect()
    assert [r["id"] for r in ones] == got


def test_fractions_and_a_busy_minute_spread_over_blocks(spark):
    from epiframe.plans.ordered import order_block

    f = spark.range(10_000).withColumn("x", F.col("id") / 10_000)
    assert f.select(order_block(f, "x").alias("b")).distinct().count() > 3000
    s = spark.range(5000).select(F.concat(F.lit("episode-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("s"))
    assert s.select(order_block(s, "s").alias("b")).distinct().count() == 5000
