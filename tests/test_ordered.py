"""Skew-safe ordering helpers: the block-cut results must equal the plain windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiframe.operators import windows as W
from epiframe.plans import ordered
from epiframe.sources import views
from tests.conftest import SF001


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _events(spark):
    return views.table(spark, SF001, "events").select(
        F.col("user_id").alias("episode_id"), "event_id", "ts", F.col("value").alias("v"))


def test_index_within_blocks_equal_row_number(spark, small_blocks):
    ev = _events(spark)
    hot = ordered.index_within(ev, ["episode_id"], ["ts", "event_id"], out="t")
    w = Window.partitionBy("episode_id").orderBy("ts", "event_id")
    ref = ev.withColumn("t", (F.row_number().over(w) - 1).cast("bigint"))
    assert _rows(hot, ["event_id", "t"]) == _rows(ref, ["event_id", "t"])


def test_index_within_global_blocks(spark, small_blocks):
    ev = _events(spark)
    hot = ordered.index_within(ev, [], ["event_id"], out="g")
    ref = ev.withColumn("g", (F.row_number().over(Window.orderBy("event_id")) - 1).cast("bigint"))
    assert _rows(hot, ["event_id", "g"]) == _rows(ref, ["event_id", "g"])


def test_running_agg_blocks_equal_window(spark, small_blocks):
    ev = _events(spark)
    for agg, fn in (("sum", F.sum), ("max", F.max)):
        hot = ordered.running_agg(ev, "v", ["event_id"], "r", keys=["episode_id"], agg=agg)
        w = Window.partitionBy("episode_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
        ref = ev.withColumn("r", fn("v").over(w))
        a = {r[0]: round(r[1], 6) for r in hot.select("event_id", "r").collect()}
        b = {r[0]: round(r[1], 6) for r in ref.select("event_id", "r").collect()}
        assert a == b


def test_running_agg_excluding_current(spark, small_blocks):
    ev = _events(spark)
    hot = ordered.running_agg(ev, "v", ["event_id"], "r", keys=["episode_id"], agg="max", include_current=False)
    w = Window.partitionBy("episode_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    ref = ev.withColumn("r", F.max("v").over(w))
    assert _rows(hot, ["event_id", "r"]) == _rows(ref, ["event_id", "r"])


def test_chunk_small_segments_equal_one_segment(spark, small_blocks):
    f = views.frames_ev(spark, SF001).select("episode_id", "t", "actions")
    cut = W.action_chunk(f, 5)  # SEGMENT = 8: many segment borders with halo copies
    whole = W.action_chunk(f, 5, segment=10 ** 9)
    a = _rows(cut.select("episode_id", "t", F.to_json("actions").alias("a")), ["episode_id", "t", "a"])
    b = _rows(whole.select("episode_id", "t", F.to_json("actions").alias("a")), ["episode_id", "t", "a"])
    assert a == b and len(a) == f.count()


def test_chunk_clamps_at_episode_end(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [5.0]), (2, 1, [6.0]), (2, 2, [7.0])],
                               "episode_id long, t long, actions array<double>")
    out = {(r.episode_id, r.t): [x[0] for x in r.actions] for r in W.action_chunk(df, 4).collect()}
    assert out[(1, 0)] == [1.0, 1.0, 1.0, 1.0]  # episode of one row
    assert out[(2, 0)] == [5.0, 6.0, 7.0, 7.0]  # shorter than H, tail clamps
    assert out[(2, 2)] == [7.0, 7.0, 7.0, 7.0]


def test_chunk_weights_match_exploded_chunks(spark):
    f = views.frames_ev(spark, SF001).select("episode_id", "t", "actions")
    w = W.chunk_weights(f, 6)
    ch = W.action_chunk(f.withColumn("actions", F.array(F.col("t").cast("double"))), 6)
    counts = ch.select("episode_id", F.explode("actions").alias("a")).select(
        "episode_id", F.col("a")[0].cast("bigint").alias("t")).groupBy("episode_id", "t").count()
    assert _rows(counts, ["episode_id", "t", "count"]) == _rows(w, ["episode_id", "t", "weight"])


def test_results_independent_of_partition_count(spark):
    from epiframe.plans.queries_core import flagship

    spark.conf.set("spark.sql.shuffle.partitions", "3")
    a = sorted(tuple(r) for r in flagship(spark, SF001).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(tuple(r) for r in flagship(spark, SF001).collect())
    assert a == b


def test_nonidle_ranges_independent_of_block_size(spark, monkeypatch):
    from epiframe.operators import ranges as RG

    f = views.frames_idle(spark, SF001)

    def result():
        return (_rows(RG.nonidle_ranges(f, "vel").fillna(-1), ["episode_id", "start", "end"]),
                _rows(RG.idle_flag(f, "vel"), ["episode_id", "t", "idle"]))

    want = result()
    for bits, segment in ((2, 8), (3, 16)):
        monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
        monkeypatch.setattr(ordered, "RANGE_BITS", 2)
        monkeypatch.setattr(ordered, "SEGMENT", segment)
        assert result() == want


def test_null_keys_ties_and_one_giant_group(spark, small_blocks):
    rows = ([(1, i, float(i % 7)) for i in range(300)] + [(None, i, float(i % 5)) for i in range(60)]
            + [(2, None, 1.0), (None, None, 2.0), (3, 5, 9.0)])
    df = spark.createDataFrame(rows, "k long, o long, v double")
    w = Window.partitionBy("k").orderBy("o")
    ref = df.withColumn("t", (F.row_number().over(w) - 1).cast("bigint"))
    got = ordered.index_within(df, ["k"], ["o"], out="t")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, ref.collect()), key=key)
    for agg, fn in (("sum", F.sum), ("max", F.max), ("min", F.min)):
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        a = ordered.running_agg(df, "v", ["o"], "r", keys=["k"], agg=agg).select("k", "o", "r")
        b = df.withColumn("r", fn("v").over(run)).select("k", "o", "r")
        assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)
    ties = spark.createDataFrame([("a", 1, i) for i in range(50)], "k string, o int, i int")
    got = ordered.index_within(ties, ["k"], ["o", "i"], out="t")
    assert sorted((r.i, r.t) for r in got.collect()) == [(i, i) for i in range(50)]


def test_blocks_keep_the_order_of_every_type(spark):
    import datetime as d

    columns = {
        "long": [-2 ** 63, -5000, -1, 0, 1, 4095, 4096, 2 ** 63 - 1],
        "double": [float("-inf"), -1e300, -2.5, -0.0, 1e-9, 0.5, 3.25, 1e18, float("inf"), float("nan")],
        "string": ["", "a", "aa", "ab", "abcd", "abcde", "b", "é"],
        "timestamp": [d.datetime(1960, 1, 1), d.datetime(1970, 1, 1), d.datetime(2024, 5, 5)],
        "date": [d.date(1960, 1, 1), d.date(1970, 1, 1), d.date(2024, 5, 5)],
    }
    for kind, values in columns.items():
        df = spark.createDataFrame([(None,)] + [(v,) for v in values], f"c {kind}")
        got = [r[0] for r in df.withColumn("b", ordered.order_block(df, "c")).orderBy("c").select("b").collect()]
        assert got == sorted(got), kind
        idx = ordered.index_within(df, [], ["c"], out="t").orderBy("t").select("c").collect()
        assert [str(r[0]) for r in idx] == [str(r[0]) for r in df.orderBy("c").collect()], kind


def test_no_keyless_window_in_plans(spark):
    import contextlib
    import io

    df = spark.range(100).withColumn("k", F.col("id") % 3)
    for plan in (ordered.index_within(df, [], ["id"], out="t"), ordered.running_agg(df, "k", ["id"], "r"),
                 ordered.index_within(df, ["k"], ["id"], out="t")):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            plan.explain("formatted")
        for part in buf.getvalue().split("Window")[1:]:
            assert "Exchange SinglePartition" not in part.split("Exchange")[0]


def test_exact_quantiles_blocks_match_numpy(spark, small_blocks):
    import numpy as np

    from epiframe.operators.stats import exact_quantiles

    ev = _events(spark).select("episode_id", "v")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["episode_id"]: r for r in exact_quantiles(ev, ["episode_id"], "v", qs).collect()}
    pdf = ev.toPandas()
    for ep, grp in pdf.groupby("episode_id"):
        want = np.quantile(grp["v"].to_numpy(), qs)
        assert np.allclose([got[ep][f"p{round(q * 100)}"] for q in qs], want)


def test_weighted_mix_independent_of_block_size(spark, monkeypatch):
    from epiframe.operators import sampling as SM

    a = spark.range(40).withColumnRenamed("id", "k")
    b = spark.range(7).withColumnRenamed("id", "k")

    def result():
        return sorted(tuple(r) for r in SM.weighted_mix(spark, {"a": a, "b": b}, {"a": 0.8, "b": 0.2}, 300, ["k"], 3).collect())

    want = result()
    monkeypatch.setattr(ordered, "BLOCK_BITS", 2)
    monkeypatch.setattr(ordered, "RANGE_BITS", 1)
    assert result() == want and len(want) == 300


def test_null_group_has_percentiles(spark):
    from epiframe.operators import evaluation as EV

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "metric string, ms double")
    got = {r.metric: r.asDict() for r in EV.latency_summary(df).collect()}
    assert got[None]["p50"] == 2.0 and got["a"]["p50"] == 5.0
