"""Episode sources.

Readers return lazy DataFrames; nothing is collected. Schema probes look at
the schema (metadata), never at rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.functions.hashing import unit_hash
from epiframe.session import join_small


def read_frames(spark: SparkSession, path: str, tasks_path: str | None = None, columns: Sequence[str] | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Frame table (+ optional ``tasks`` dimension giving ``prompt``); columns pruned at the scan."""
    df = spark.read.format(fmt).load(path)
    if columns:
        df = df.select(*columns)
    if tasks_path:
        tasks = spark.read.format(fmt).load(tasks_path).select("task_index", F.col("task").alias("prompt"))
        df = join_small(df, tasks, ["task_index"], "left")
    return df


def explode_steps(episodes: DataFrame, steps: str = "steps", keys: Sequence[str] = ("episode_id",),
                  t: str = "t", base: str | None = None) -> DataFrame:
    """Nested records ``steps ARRAY<STRUCT>`` → one row per step with its index.

    ``base`` (optional column) is the index of the record's first step, for
    episodes stored as several bounded records.
    """
    e = episodes.select(*keys, *([base] if base else []), F.posexplode(steps).alias("_p", "_s"))
    idx = F.col("_p") + (F.col(base) if base else F.lit(0))
    return e.select(*keys, idx.cast("bigint").alias(t), "_s.*")


def nest_steps(frames: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("episode_id",), t: str = "t",
               steps: str = "steps", max_steps: int = 4096) -> DataFrame:
    """Inverse of ``explode_steps``: frames → nested records of at most ``max_steps`` steps.

    Record ``(episode, block)`` holds steps ``block*max_steps ..``; its
    ``first_step`` column is the ``base`` for ``explode_steps``. No episode
    is ever gathered into one row or one task.
    """
    blk = (F.col(t) / F.lit(max_steps)).cast("bigint")
    g = frames.groupBy(*keys, blk.alias("block")).agg(F.array_sort(F.collect_list(F.struct(t, *cols))).alias("_s"))
    return g.select(*keys, (F.col("block") * max_steps).alias("first_step"),
                    F.transform("_s", lambda s: s.dropFields(t)).alias(steps))


def optional_columns(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Which optional columns exist (schema probe; no rows read)."""
    return [c for c in candidates if c in df.columns]


def presence_report(df: DataFrame, candidates: Sequence[str], file_col: str | None = None) -> DataFrame:
    """S8 with merged schemas: per column (and file) how many rows carry a value.

    Reading many files with ``mergeSchema`` fills absent columns with null;
    this reports mixed presence instead of trusting the first file.
    """
    present = optional_columns(df, candidates)
    base = df.withColumn("_file", F.input_file_name() if file_col is None else F.col(file_col))
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count(F.col(c)).alias(c) for c in present]
    g = base.groupBy("_file").agg(*aggs) if file_col is not None else base.agg(*aggs)
    cols = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present_rows")) for c in present])
    keep = ["_file"] if file_col is not None else []
    return g.select(*keep, "rows", F.inline(cols))


def drop_camera_columns(df: DataFrame, pattern: str = ".*depth.*") -> DataFrame:
    """Drop camera columns by name pattern (e.g. depth streams)."""
    import re

    rx = re.compile(pattern)
    return df.drop(*[c for c in df.columns if rx.fullmatch(c)])


def drop_nested_fields(df: DataFrame, col: str, fields: Sequence[str]) -> DataFrame:
    """Nested group → struct with ignored keys removed (``dropFields``; paths with '.')."""
    return df.withColumn(col, F.col(col).dropFields(*fields))


def fake_rows(spark: SparkSession, n: int, spec: Mapping[str, tuple[str, int]], seed: int = 0) -> DataFrame:
    """Row ``i`` is a pure function of ``i``: floats uniform in [-1, 1), ints in [0, 2048), others 0.

    ``spec`` maps a column to (kind, length) with kind in {"float", "int", "zero"}.
    Values come from a hash of (i, column, dim), so any partitioning gives
    the same rows.
    """
    base = spark.range(n).withColumnRenamed("id", "i")
    cols = {}
    for name, (kind, length) in spec.items():
        dims = F.sequence(F.lit(0), F.lit(length - 1))
        if kind == "float":
            cols[name] = F.transform(dims, lambda d: unit_hash(F.col("i"), F.lit(name), d, seed=seed) * F.lit(2.0) - F.lit(1.0))
        elif kind == "int":
            cols[name] = F.transform(dims, lambda d: F.floor(unit_hash(F.col("i"), F.lit(name), d, seed=seed) * F.lit(2048)).cast("int"))
        else:
            cols[name] = F.array_repeat(F.lit(0.0), length)
    return base.withColumns(cols)


def records_pivot(records: DataFrame, series: Mapping[str, str], step: str | Sequence[str] = "step") -> DataFrame:
    """Policy records → per-dimension series ``(step, dim, <name>…)``, one column per record field.

    The fields of a record are zipped and exploded in place: no shuffle.
    """
    steps = [step] if isinstance(step, str) else list(step)
    zipped = F.arrays_zip(*[F.col(col).alias(name) for name, col in series.items()])
    rows = records.select(*steps, F.posexplode(zipped).alias("dim", "v"))
    return rows.select(*steps, F.col("dim").cast("bigint").alias("dim"), *[F.col(f"v.{name}").alias(name) for name in series])
