"""Sinks and sources: write modes, frame table, JSON lines, flattened records, CSV/parquet reports."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from epiframe.operators import ranges as RG
from epiframe.operators import stats as S
from epiframe.session import checkpoint_dir
from epiframe.sinks import writers as WR
from epiframe.sources import readers as RD
from epiframe.sources import views
from tests.conftest import SF001


def _path(spark, name):
    return os.path.join(checkpoint_dir(spark), "io-tests", f"{name}-{uuid.uuid4().hex[:8]}")


def test_frame_table_write_modes(spark):
    f = views.frames_ev(spark, SF001).select("episode_id", "t", "task", "state")
    ft = WR.to_frame_table(f, 10).withColumn("dataset", F.lit("events"))
    path = _path(spark, "frames")
    WR.write_frame_table(ft, path, mode="fail")
    back = spark.read.parquet(path)
    assert back.count() == f.count()
    assert back.agg(F.max("timestamp")).first()[0] == pytest.approx(back.agg(F.max("frame_index")).first()[0] / 10)
    with pytest.raises(Exception):
        WR.write_frame_table(ft, path, mode="fail")  # fail-if-exists
    WR.write_frame_table(ft, path, mode="append")
    assert spark.read.parquet(path).count() == 2 * f.count()
    WR.write_frame_table(ft, path, mode="overwrite")
    assert spark.read.parquet(path).count() == f.count()


def test_stats_json_file_roundtrip(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([4.0, 0.0],)], "state array<double>")
    st = S.norm_stats(S.long_values(df, ["state"]))
    path = _path(spark, "stats")
    S.save_stats(st, path)
    back = S.load_stats(spark, path)
    a = sorted((r.key, r.dim, r.mean, r.std) for r in st.collect())
    b = sorted((r.key, r.dim, r.mean, r.std) for r in back.collect())
    assert a == b


def test_keep_ranges_json_lines_roundtrip(spark):
    ranges = spark.createDataFrame([(1, 0, 5), (1, 10, 20), (2, None, None)], "episode_id long, start long, end long")
    path = _path(spark, "ranges")
    WR.write_json_lines(RG.keep_ranges_json(ranges, per_line=1), path)
    lines = spark.read.json(path)
    assert lines.count() == 3  # episode 1 split over two lines, episode 2 has []
    back = RG.read_keep_ranges(lines.select("episode_key", "ranges"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", 0, 5), ("1", 10, 20)]
    doc = spark.createDataFrame([('{"a--b": [[1, 4], [6, 9]], "c--d": []}',)], "value string")
    assert sorted(tuple(r) for r in RG.read_keep_ranges_map(doc).collect()) == [("a--b", 1, 4), ("a--b", 6, 9)]


def test_flattened_records_and_reports(spark):
    rec = spark.sql("select named_struct('state', array(1d, 2d)) as inputs, named_struct('actions', array(3d)) as outputs")
    path = _path(spark, "records")
    WR.write_records(rec, path)
    WR.write_records(rec, path)  # appended per step
    assert sorted(spark.read.parquet(path).columns) == ["inputs/state", "outputs/actions"]
    assert WR.read_records(spark, path).collect() == 2 * rec.collect()
    rollouts = spark.createDataFrame([(1.0, 10, "a.mp4"), (0.5, 12, "b.mp4")], "success double, duration int, video string")
    csv = _path(spark, "rollouts")
    WR.write_table(rollouts, csv, fmt="csv")
    assert spark.read.option("header", "true").csv(csv).count() == 2


def test_nested_steps_roundtrip_bounded(spark):
    frames = spark.range(10).select(F.lit(7).cast("bigint").alias("episode_id"), F.col("id").alias("t"),
                                    (F.col("id") * 2).alias("v"))
    nested = RD.nest_steps(frames, ["v"], max_steps=4)
    assert nested.count() == 3 and max(len(r.steps) for r in nested.collect()) <= 4
    back = RD.explode_steps(nested, base="first_step")
    assert sorted((r.t, r.v) for r in back.collect()) == [(i, 2 * i) for i in range(10)]


def test_fake_rows_deterministic(spark):
    a = RD.fake_rows(spark, 50, {"state": ("float", 3), "tok": ("int", 2)}, seed=4)
    b = RD.fake_rows(spark, 50, {"state": ("float", 3), "tok": ("int", 2)}, seed=4).repartition(7)
    ra = sorted((r.i, tuple(r.state), tuple(r.tok)) for r in a.collect())
    rb = sorted((r.i, tuple(r.state), tuple(r.tok)) for r in b.collect())
    assert ra == rb
    assert all(-1 <= x < 1 for r in ra for x in r[1]) and all(0 <= x < 2048 for r in ra for x in r[2])


def test_resumed_write_adds_each_episode_once(spark, monkeypatch):
    rows = [(None if e == 3 else e, t) for e in range(9) for t in range(4)]
    df = spark.createDataFrame(rows, "episode_id long, t long")
    out = WR.Resumable(spark, _path(spark, "resume"))
    with pytest.raises(FileNotFoundError):
        out.read()
    commits, commit = [], WR.Resumable._commit

    def dies(self, entry):
        if len(commits) == 2:
            raise RuntimeError("killed")  # the third batch's files are there, its entry is not
        commits.append(1)
        commit(self, entry)

    monkeypatch.setattr(WR.Resumable, "_commit", dies)
    with pytest.raises(RuntimeError):
        out.write(df, batches=4)
    half = out.read().count()
    assert 0 < half < len(rows)
    monkeypatch.setattr(WR.Resumable, "_commit", commit)
    out.write(df, batches=4)
    assert sorted(map(str, out.read().collect())) == sorted(map(str, df.collect()))
    out.write(df.unionByName(spark.createDataFrame([(50, 0)], df.schema)), batches=2, sort_within=["t"])
    assert out.read().count() == len(rows) + 1


def test_keep_ranges_document_is_one_json_document(spark):
    import json

    ranges = spark.createDataFrame([(1, 10 * i, 10 * i + 5) for i in range(7)] + [(2, None, None), (3, 1, 2)], "episode_id long, start long, end long")
    ranges = ranges.withColumn("folder", F.concat(F.lit('a"b/'), F.col("episode_id")))
    path = _path(spark, "doc")
    WR.write_document(RG.keep_ranges_document(ranges, ["folder", "episode_id"], per_line=2), path)
    folder = path.removeprefix("file:")
    text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    want = {'a"b/1--1': [[10 * i, 10 * i + 5] for i in range(7)], 'a"b/2--2': [], 'a"b/3--3': [[1, 2]]}
    assert json.loads(text) == want
    doc = spark.createDataFrame([(text.replace("\n", " "),)], "value string")
    assert sorted(tuple(r) for r in RG.read_keep_ranges_map(doc).collect()) == sorted((k, a, b) for k, v in want.items() for a, b in v)
    empty = RG.keep_ranges_document(ranges.limit(0), ["episode_id"])
    assert [r["value"] for r in empty.orderBy("place").collect()] == ["{", "}"]
