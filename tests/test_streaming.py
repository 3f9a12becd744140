"""Streaming operators: over many micro-batches, a restart and a retried batch they equal the batch twin."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from epiframe.operators import evaluation as EV
from epiframe.operators import vector_stats as VS
from epiframe.operators import windows as W
from epiframe.plans.ordered import index_within
from epiframe.sources import views
from epiframe.streaming import streams as ST
from tests.conftest import SF001


def _land(df, path, part, lo, hi):
    """Append the rows with lo <= part < hi, one file a value of ``part``, in order of their time."""
    for v in range(lo, hi):
        df.filter(F.expr(part) == v).coalesce(1).write.mode("append").parquet(path)
        folder = path.removeprefix("file:")
        for f in os.listdir(folder):
            if f.endswith(".parquet") and os.path.getmtime(os.path.join(folder, f)) > 1_100_000_000:
                os.utime(os.path.join(folder, f), (1_000_000_000 + v, 1_000_000_000 + v))


def _in_two_runs(spark, df, part, values, run, name):
    """Half of the files, a run, the rest, the run again from its checkpoint; one file a micro-batch."""
    src, out = ST.scratch(spark, f"{name}-src"), ST.scratch(spark, f"{name}-out")
    _land(df, src, part, 0, values // 2)
    run(ST.file_stream(spark, src, df.schema, 1), out)
    _land(df, src, part, values // 2, values)
    return run(ST.file_stream(spark, src, df.schema, 1), out), out


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_stats_and_quantiles_over_batches(spark):
    f = views.frames_ev(spark, SF001).select("t", "state").withColumn(
        "state", F.array(F.col("state")[0] * F.pow(F.lit(10.0), F.col("t") % 7 - 3), F.col("state")[1]))  # the range grows
    got, _ = _in_two_runs(spark, f, "t div 16", 8, lambda s, out: ST.stream_stats(spark, s, {"state": "state"}, out), "stats")
    want = VS.growing_stats(f.filter("t < 128").repartition(5), {"state": "state"})
    cols = ["dim", "count", "min", "max", "q01", "q99"]
    assert _rows(got, *cols) == _rows(want, *cols)
    for g, w in zip(_rows(got, "dim", "mean", "std"), _rows(want, "dim", "mean", "std")):
        assert np.allclose(g, w, rtol=1e-12)
    x = np.sort([r[0][0] for r in f.filter("t < 128").select("state").collect()])
    row = [r for r in got.collect() if r["dim"] == 0][0]
    for q, name in ((0.01, "q01"), (0.99, "q99")):
        assert abs(row[name] - x[int(np.ceil(q * len(x))) - 1]) <= (x[-1] - x[0]) / 2500


def test_broker_equals_batch_replay(spark):
    f = views.frames_ev(spark, SF001).select("episode_id", "t", "actions")
    f = f.withColumn("episode_id", F.when(F.col("episode_id") != f.agg(F.min("episode_id")).first()[0], F.col("episode_id")))  # a null session
    ch = index_within(f.drop("t"), ["episode_id"], ["actions"], out="t")
    ch = W.action_chunk(ch, 3).withColumnRenamed("actions", "plan").filter("t < 48")
    got, _ = _in_two_runs(spark, ch, "t div 8", 6, lambda s, out: ST.stream_broker(spark, s, 3, out), "broker")
    plans = {(r[0], r[1]): r[2] for r in ch.filter("t % 3 = 0").select("episode_id", "t", "plan").collect()}
    want = sorted(((e, t, t, plans[(e, t - t % 3)][t % 3]) for e, t in ch.select("episode_id", "t").collect()), key=str)
    assert _rows(got, "episode_id", "t", "call", "action") == want


def _readings(spark):
    ev = views.table(spark, SF001, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return index_within(ev, [], ["event_id"], out="arrival")


def test_newest_equals_batch(spark):
    r = _readings(spark)
    got, _ = _in_two_runs(spark, r, "arrival div 125", 8, lambda s, out: ST.stream_newest(spark, s, out), "newest")
    want = W.newest_only(r.filter("channel IS NOT NULL"), arrival="arrival")
    assert _rows(got.filter("channel IS NOT NULL"), "event_id") == _rows(want, "event_id")
    assert got.filter("channel IS NULL").count() >= 1


def test_rate_equals_batch(spark):
    r = _readings(spark)
    got, out = _in_two_runs(spark, r, "arrival div 125", 8, lambda s, out: ST.stream_rate(spark, s, out), "rate")
    want = EV.rate_last50(index_within(r, ["channel"], ["arrival"], out="seq"))
    assert _rows(got, "event_id", "seq", "rate") == _rows(want, "event_id", "seq", "rate")
    state = ST.Versions(spark, out + "_state", "channel string, seq long, _ts long")
    assert state.latest().groupBy("channel").count().agg(F.max("count")).first()[0] <= 49
    assert len(state.numbers()) <= 3


def test_log_equals_batch(spark):
    lines = index_within(views.log_lines(spark, SF001), [], ["line_id"], out="n")
    got, _ = _in_two_runs(spark, lines, "n div 250", 6, lambda s, out: ST.stream_log(spark, s, 100, out), "log")
    want = EV.log_interval(EV.log_extract(lines.filter("n < 1500")), 100)
    assert _rows(got, "window", "last_step", "n") == _rows(want, "window", "last_step", "n")
    assert {r[0]: round(r[3], 9) for r in got.collect()} == {r[0]: round(r[3], 9) for r in want.collect()}


def test_ingest_of_episodes_over_many_batches(spark):
    rows = [(e, t, (e + 3 * t) % 6, t == 2 * e) for e in range(1, 9) for t in range(2 * e + 1)]  # an episode's frames lie in all files
    rows = [(e, t, 5 if end else p, end) for e, t, p, end in rows]
    rows += [(2, 99, 7, False), (None, 0, 1, False), (None, 1, 6, True), (20, 0, 0, False)]  # late; null id; never ended
    df = spark.createDataFrame(rows, "episode_id long, t long, part int, end boolean")

    def run(s, out):
        return ST.Ingest(spark, df.schema, 4, out, end="end").run(s)

    got, _ = _in_two_runs(spark, df, "part", 8, run, "ingest")
    good = [(e, t) for e, t, p, _ in rows if e is not None and 2 <= e <= 8 and t != 99]
    assert _rows(got.good(), "episode_id", "t") == sorted(good, key=str)
    assert _rows(got.rejects(), "episode_id", "reason", "n") == sorted([(1, "too_short", 3), (2, "after_end", 1), (None, "too_short", 2)], key=str)
    assert _rows(got.open(), "episode_id") == [(20,)]
    got.close().close()  # twice: the second finds nothing open
    assert _rows(got.rejects().filter("episode_id = 20"), "reason", "n") == [("too_short", 1)]
    assert got.open().count() == 0
    whole = ST.Ingest(spark, df.schema, 4, ST.scratch(spark, "ingest-one"), end="end")
    whole._batch(df.filter("part < 7"), 0, False)
    assert _rows(whole.good(), "episode_id", "t") == sorted(good, key=str)  # one file or many: the same frames
    whole._batch(df.filter("part < 7"), 0, False)  # the batch is tried again
    assert _rows(whole.good(), "episode_id", "t") == sorted(good, key=str)


def test_ingest_closes_idle_episodes(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1), (3, 0, 2), (3, 1, 3)], "episode_id long, t long, part int")
    src, out = ST.scratch(spark, "idle-src"), ST.scratch(spark, "idle-out")
    _land(df, src, "part", 0, 4)
    got = ST.Ingest(spark, df.schema, 2, out, idle_batches=2).run(ST.file_stream(spark, src, df.schema, 1))
    assert _rows(got.good(), "episode_id", "t") == [(1, 0), (1, 1)]
    assert _rows(got.rejects(), "episode_id", "reason") == [(2, "too_short")]
    assert _rows(got.open(), "episode_id") == [(3,), (3,)]
