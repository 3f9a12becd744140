"""Structured Streaming operators (R1–R5), each with a batch twin.

A stream is any streaming DataFrame (file sources in the queries and tests). Every
micro-batch is handled with the batch operators, so a hot episode or channel is cut into
blocks there as well; nothing holds a group in one task. What has to outlive a
micro-batch is a small table of its own, kept as one snapshot per batch (``Versions``):
a retried batch reads the snapshot before it and overwrites its own output and snapshot,
so that every row counts exactly once, also across restarts.

Arrival order is the order of the micro-batches, then the order columns given.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.operators import vector_stats as VS
from epiframe.operators import windows as W
from epiframe.plans.ordered import index_within, join_null_safe, neighbours, running_agg
from epiframe.session import checkpoint_dir

#: Timestamps of a channel's rate.
RATE_READINGS = 50


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local temp dir on a cluster)."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream; new files in it arrive in order of their time."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], out: str) -> None:
    """Handle what has arrived, batch by batch, and stop; the next run goes on after it."""
    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


class Batches:
    """An append-only table in one folder per micro-batch; a retried batch replaces its own."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def put(self, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(self.path).drop("batch")

    def numbers(self) -> list[int]:
        fs, root = _folder(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


class Versions(Batches):
    """A state table as one snapshot per micro-batch; two finished ones are kept."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        super().__init__(spark, path, schema)

    def before(self, batch_id: int) -> DataFrame:
        """The state the batch starts from."""
        older = [n for n in self.numbers() if n < batch_id]
        if not older:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={older[-1]}")

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def put(self, batch_id: int, df: DataFrame) -> None:
        super().put(batch_id, df)
        fs, _ = _folder(self.spark, self.path)
        for n in self.numbers():
            if n < batch_id - 1:
                fs.delete(_folder(self.spark, f"{self.path}/batch={n}")[1], True)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


# ---------------------------------------------------------------- R1 incremental norm stats
def stream_stats(spark: SparkSession, stream: DataFrame, vectors: dict[str, str], out: str) -> DataFrame:
    """Count, mean, std, min, max and q01, q99 of the stream's vectors so far.

    Every batch leaves its tasks' mergeable moments and growing histograms
    (``vector_stats``), a few rows; they merge exactly whatever the batches were.
    """
    parts = Batches(spark, out)
    run_to_end(stream.select(*dict.fromkeys(vectors.values())), lambda b, n: parts.put(n, VS.growing_parts(b, vectors)), out)
    return VS.merged_growing(parts.read())


# ---------------------------------------------------------------- R2 stateful chunk broker
def stream_broker(spark: SparkSession, stream: DataFrame, horizon: int, out: str, keys: Sequence[str] = ("episode_id",),
                  t: str = "t", plan: str = "plan") -> DataFrame:
    """R2: per session hold the current chunk, play its next row at each call, replan when it is used up.

    ``plan`` is the chunk (rows of actions) a policy would return at that call; only
    every ``horizon``-th call of a session looks at it. State: calls so far and the open
    chunk of each session. Returns keys, t, call, action (all dims).
    """
    k = list(keys)
    kinds = stream.schema
    plan_type = kinds[plan].dataType
    state = Versions(spark, out + "_state", T.StructType([kinds[c] for c in k] + [T.StructField("calls", T.LongType()), T.StructField("open", plan_type)]))
    result = Batches(spark, out, T.StructType([kinds[c] for c in k] + [kinds[t], T.StructField("call", T.LongType()),
                                                                       T.StructField("action", plan_type.elementType)]))

    def each(batch: DataFrame, batch_id: int) -> None:
        old = state.before(batch_id)
        rows = index_within(batch.select(*k, t, plan), k, [t], out="_i")
        rows = join_null_safe(rows, old.select(*k, "calls"), k, "left")
        rows = rows.withColumn("call", F.coalesce("calls", F.lit(0)) + F.col("_i")).withColumn("block", F.expr(f"call div {horizon}"))
        plans = rows.filter(F.col("call") % horizon == 0).select(*k, "block", F.col(plan).alias("_chunk"))
        open_ = old.filter(F.col("calls") % horizon != 0).select(*k, F.expr(f"calls div {horizon}").alias("block"), F.col("open").alias("_chunk"))
        rows = join_null_safe(rows.select(*k, t, "call", "block"), plans.unionByName(open_), [*k, "block"], "left")
        result.put(batch_id, rows.select(*k, t, "call", F.get("_chunk", (F.col("call") % horizon).cast("int")).alias("action")))
        new = rows.groupBy(*k).agg((F.max("call") + 1).alias("calls"), F.max_by("_chunk", "call").alias("open"))
        kept = join_null_safe(old, new.select(*k, F.lit(True).alias("_new")), k, "left").filter(F.col("_new").isNull()).drop("_new")
        state.put(batch_id, new.unionByName(kept))

    run_to_end(stream, each, out)
    return result.read()


# ---------------------------------------------------------------- R3 newest-only and rate monitors
def stream_newest(spark: SparkSession, stream: DataFrame, out: str, channel: str = "channel", ts: str = "ts",
                  arrival: Sequence[str] = ("arrival",)) -> DataFrame:
    """A reading is taken if it is newer than all its channel's readings that arrived before. State: newest time."""
    state = Versions(spark, out + "_state", T.StructType([stream.schema[channel], T.StructField("newest", stream.schema[ts].dataType)]))
    taken = Batches(spark, out, stream.schema)

    def each(batch: DataFrame, batch_id: int) -> None:
        old = state.before(batch_id)
        rows = running_agg(batch, ts, list(arrival), "_prev", keys=[channel], agg="max", include_current=False)
        rows = join_null_safe(rows, old, [channel], "left").withColumn("_prev", F.greatest("_prev", "newest"))
        taken.put(batch_id, rows.filter(F.col("_prev").isNull() | (F.col(ts) > F.col("_prev"))).select(*batch.columns))
        both = batch.select(channel, F.col(ts).alias("newest")).unionByName(old)
        state.put(batch_id, both.groupBy(channel).agg(F.max("newest").alias("newest")))

    run_to_end(stream, each, out)
    return taken.read()


def stream_rate(spark: SparkSession, stream: DataFrame, out: str, channel: str = "channel", ts: str = "ts",
                arrival: Sequence[str] = ("arrival",), readings: int = RATE_READINGS) -> DataFrame:
    """Per reading, (n - 1) / (span) of its channel's last ``readings`` times (numbers), itself included.

    State: each channel's last ``readings`` - 1 times with their numbers; a batch's
    readings are numbered on and look back over both through ``ordered.neighbours``.
    Returns the stream's columns, seq and rate (null for one time or no span).
    """
    kinds = stream.schema
    state = Versions(spark, out + "_state", T.StructType([kinds[channel], T.StructField("seq", T.LongType()), T.StructField("_ts", kinds[ts].dataType)]))
    rates = Batches(spark, out, T.StructType([*kinds.fields, T.StructField("seq", T.LongType()), T.StructField("rate", T.DoubleType())]))

    def each(batch: DataFrame, batch_id: int) -> None:
        old = state.before(batch_id)
        seen = old.groupBy(channel).agg((F.max("seq") + 1).alias("_seen"))
        rows = join_null_safe(index_within(batch, [channel], list(arrival), out="_i"), seen, [channel], "left")
        rows = rows.withColumn("seq", F.coalesce("_seen", F.lit(0)) + F.col("_i")).withColumn("_ts", F.col(ts)).drop("_seen", "_i")
        both = rows.withColumn("_now", F.lit(True)).unionByName(old.withColumn("_now", F.lit(False)), allowMissingColumns=True)
        both = neighbours(both, [channel], "seq", ["_ts"], before=readings - 1, out="_w")
        times = F.transform("_w", lambda x: x["_ts"])
        n, span = F.size(times), F.array_max(times) - F.array_min(times)
        rated = both.withColumn("rate", F.when((n > 1) & (span > 0), (n - 1) / span)).filter("_now")
        rates.put(batch_id, rated.select(*batch.columns, "seq", "rate"))
        every = rows.select(channel, "seq", "_ts").unionByName(old)
        top = every.groupBy(channel).agg(F.max("seq").alias("_top"))
        last = join_null_safe(every, top, [channel]).filter(F.col("seq") > F.col("_top") - (readings - 1)).drop("_top")
        state.put(batch_id, last)

    run_to_end(stream, each, out)
    return rates.read()


# ---------------------------------------------------------------- R4 interval log means
def stream_log(spark: SparkSession, stream: DataFrame, interval: int, out: str) -> DataFrame:
    """Means per log window (``ceil(step / L)``); a batch adds its own sums, they are added up when read."""
    from epiframe.operators.evaluation import log_extract

    parts = Batches(spark, out, "window long, last_step long, n long, total double")

    def each(batch: DataFrame, batch_id: int) -> None:
        m = log_extract(batch)
        parts.put(batch_id, m.groupBy(W.log_bucket("step", interval).alias("window")).agg(
            F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n"), F.sum("loss").alias("total")))

    run_to_end(stream, each, out)
    return parts.read().groupBy("window").agg(
        F.max("last_step").alias("last_step"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("loss_mean"))


# ---------------------------------------------------------------- R5 ingest with rejects
class Ingest:
    """Episodes whose frames arrive over any number of micro-batches.

    An episode is open until a frame with a true ``end`` arrives (``idle_batches``: or
    until so many batches brought nothing for it; ``close``: or until told). Frames of
    open episodes wait in a state table. On closing, the episode is judged as a whole:
    its frames go to ``good``, each once, or the episode to ``rejects(episode, reason,
    n)``: ``too_short``, or ``after_end`` for frames of an episode already closed.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, min_frames: int, out: str, episode: str = "episode_id",
                 end: str | None = None, idle_batches: int | None = None):
        self.min_frames, self.out, self.episode, self.end, self.idle = min_frames, out, episode, end, idle_batches
        self.schema, kind = schema, schema[episode]
        self.pending = Versions(spark, f"{out}/pending", T.StructType([*schema.fields, T.StructField("_at", T.LongType())]))
        self.closed = Batches(spark, f"{out}/closed", T.StructType([kind]))
        self.good_ = Batches(spark, f"{out}/good", schema)
        self.rejects_ = Batches(spark, f"{out}/rejects", T.StructType([kind, T.StructField("reason", T.StringType()), T.StructField("n", T.LongType())]))

    def run(self, stream: DataFrame) -> "Ingest":
        run_to_end(stream, lambda b, n: self._batch(b, n, False), self.out)
        return self

    def close(self) -> "Ingest":
        """Close every open episode (the source has ended). A batch of its own: running it again changes nothing."""
        last = max(self.pending.numbers(), default=-1)
        if last >= 0:
            self._batch(self.pending.spark.createDataFrame([], self.schema), last + 1, True)
        return self

    def _batch(self, batch: DataFrame, batch_id: int, everything: bool) -> None:
        e, n_before = self.episode, [n for n in self.closed.numbers() if n < batch_id]
        spark, schema = self.closed.spark, self.closed.schema
        done = (spark.read.schema(schema).parquet(*[f"{self.closed.path}/batch={n}" for n in n_before]) if n_before
                else spark.createDataFrame([], schema))
        known = done.select(e, F.lit(True).alias("_done"))
        new = join_null_safe(batch.select(*self.schema.names), known, [e], "left")
        late = new.filter("_done").groupBy(e).agg(F.lit("after_end").alias("reason"), F.count(F.lit(1)).alias("n"))
        fresh = new.filter(F.col("_done").isNull()).drop("_done").withColumn("_at", F.lit(batch_id).cast("long"))
        frames = self.pending.before(batch_id).unionByName(fresh)
        ended = F.max(F.coalesce(F.col(self.end), F.lit(False))) if self.end else F.lit(False)
        shut = ended if not everything else F.lit(True)
        per = frames.groupBy(e).agg(shut.alias("_end"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
        if self.idle is not None:
            per = per.withColumn("_end", F.col("_end") | (F.lit(batch_id) - F.col("_last") >= self.idle))
        judged = join_null_safe(frames, per, [e])
        self.good_.put(batch_id, judged.filter(F.col("_end") & (F.col("_n") >= self.min_frames)).select(*self.schema.names))
        short = per.filter(F.col("_end") & (F.col("_n") < self.min_frames)).select(e, F.lit("too_short").alias("reason"), F.col("_n").alias("n"))
        self.rejects_.put(batch_id, short.unionByName(late))
        self.closed.put(batch_id, per.filter("_end").select(e))
        self.pending.put(batch_id, judged.filter(~F.col("_end")).drop("_end", "_last", "_n"))

    def good(self) -> DataFrame:
        return self.good_.read()

    def rejects(self) -> DataFrame:
        return self.rejects_.read()

    def open(self) -> DataFrame:
        """Frames of episodes that still wait."""
        return self.pending.latest().drop("_at")


__all__: Sequence[str] = ("Batches", "Ingest", "Versions", "file_stream", "run_to_end", "scratch", "stream_broker", "stream_log",
                          "stream_newest", "stream_rate", "stream_stats")
