"""Sinks (K1–K7): frame tables, JSON stats and ranges, flattened records, reports.

Writes go through the DataFrame writer (partitioned, distributed); output
modes map the reference's overwrite / fail-if-exists / resume choices.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.operators.schema import flatten_struct, unflatten_struct
from epiframe.plans.ordered import index_within
from epiframe.session import join_small

# K2: reference behaviours → writer modes ("resume" goes through ``Resumable``).
MODES = {"overwrite": "overwrite", "fail": "errorifexists", "append": "append"}


class Resumable:
    """K2 resume: a table written in batches of episodes, each committed by an entry in a manifest.

    A batch's files are written first, then its entry with the batch's folder and
    episodes. What has no entry does not exist for readers, so a run that dies leaves
    nothing half; the next run writes the episodes that no entry names, each once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("episode_id",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _entries(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(f"{self.path}/_manifest")

    def done(self, like: DataFrame) -> DataFrame:
        """Keys of the committed episodes."""
        entries = self._entries()
        return like.select(*self.keys).limit(0) if entries is None else entries.select(*self.keys)

    def write(self, frames: DataFrame, batches: int = 1, sort_within: Sequence[str] = ()) -> int:
        """Add the episodes that are not there yet; returns the number of batches committed."""
        todo = join_null_safe_anti(frames, self.done(frames), self.keys)
        n = 0
        for b in range(batches):
            some = todo.filter(F.pmod(F.xxhash64(*self.keys), F.lit(batches)) == b)
            folder = f"part-{uuid.uuid4().hex}"
            sorted_ = some.sortWithinPartitions(*sort_within) if sort_within else some
            sorted_.write.parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(frames.schema).parquet(f"{self.path}/{folder}")
            self._commit(written.select(*self.keys).distinct().withColumn("_folder", F.lit(folder)))
            n += 1
        return n

    def _commit(self, entry: DataFrame) -> None:
        entry.write.mode("append").parquet(f"{self.path}/_manifest")

    def read(self) -> DataFrame:
        """All committed rows."""
        entries = self._entries()
        if entries is None:
            raise FileNotFoundError(f"nothing committed under {self.path}")
        folders = [r[0] for r in entries.select("_folder").distinct().collect()]  # a row a batch
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in sorted(folders)])


def join_null_safe_anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys ``right`` lacks; null matches null."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on]).distinct()
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(r, cond, "left_anti")


def to_frame_table(frames: DataFrame, fps: float, episode_order: Sequence[str] = ("episode_id",), t: str = "t",
                   task: str = "task") -> DataFrame:
    """Dense ``episode_index``, ``frame_index``, ``timestamp = frame_index / fps``, dense ``task_index``.

    Dense numbers come from the (small) distinct episode and task tables,
    numbered with ``index_within`` and joined back.
    """
    eps = frames.select(*episode_order).distinct()
    eps = index_within(eps, [], list(episode_order), out="episode_index")
    tasks = frames.select(task).distinct()
    tasks = index_within(tasks, [], [task], out="task_index")
    out = join_small(frames, eps, list(episode_order))
    out = join_small(out, tasks, [task])
    return out.withColumn("frame_index", F.col(t).cast("bigint")).withColumn(
        "timestamp", F.col(t).cast("double") / F.lit(float(fps)))


def write_frame_table(df: DataFrame, path: str, mode: str = "fail", partition_by: Sequence[str] = ("dataset",),
                      sort_within: Sequence[str] = ("episode_index", "frame_index")) -> None:
    """K1/K2: partitioned parquet, rows sorted inside each file by episode and frame."""
    w = df.sortWithinPartitions(*[c for c in sort_within if c in df.columns]).write.mode(MODES.get(mode, mode))
    parts = [c for c in partition_by if c in df.columns]
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def write_tasks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tasks dimension ``(task_index, task)``."""
    df.select("task_index", "task").distinct().write.mode(MODES.get(mode, mode)).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3/K4: one JSON document per row (stats document, keep-range lines)."""
    out = df if df.columns == ["value"] else df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    out.write.mode(MODES.get(mode, mode)).text(path)


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """K5: nested per-step records as flat columns named ``a/b/c``."""
    flatten_struct(df).write.mode(MODES.get(mode, mode)).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """K5 read side: the nested records again."""
    return unflatten_struct(spark.read.parquet(path))


def write_document(lines: DataFrame, path: str, order: Sequence[str] = ("place", "episode_key", "part"), mode: str = "overwrite") -> None:
    """K4: text files whose lines, file after file in order of name, are the document (a range of it per task)."""
    lines.orderBy(*order).select("value").write.mode(MODES.get(mode, mode)).text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", header: bool = True) -> None:
    """K6: timing table (parquet), rollout results (csv), evaluation results."""
    w = df.write.mode(MODES.get(mode, mode)).format(fmt)
    if fmt == "csv":
        w = w.option("header", str(header).lower())
    w.save(path)
