"""Dimension joins and keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.session import join_small

# Fixed value: prompt used when an episode has no annotation.
DEFAULT_PROMPT = "Do something"


def join_task_prompt(df: DataFrame, tasks: DataFrame, index: str = "task_index", out: str = "prompt") -> DataFrame:
    """``prompt = tasks[task_index]``; an unknown index fails the job, a missing column fails planning."""
    if index not in df.columns:
        raise KeyError(f"column {index!r} not found; cannot look up the task prompt")
    t = tasks.select(F.col("task_index").alias(index), F.col("task").alias("_task"))
    j = join_small(df, t, [index], "left")
    return j.withColumn(out, F.when(F.col("_task").isNull(), F.raise_error(
        F.concat(F.lit("unknown task index "), F.col(index).cast("string")))).otherwise(F.col("_task"))).drop("_task")


def join_annotation(df: DataFrame, ann: DataFrame, key: str = "episode_id", col: str = "instruction",
                    default: str = DEFAULT_PROMPT) -> DataFrame:
    """Annotation lookup with a default for unannotated episodes."""
    a = ann.select(key, F.col(col).alias("_ann"))
    return join_small(df, a, [key], "left").withColumn(col, F.coalesce("_ann", F.lit(default))).drop("_ann")


def view_pairs(df: DataFrame, views: Sequence[str]) -> DataFrame:
    """For every pair of view columns (arrays of numbers): identical flag and mean |a - b|."""
    cols = {}
    for i, a in enumerate(views):
        for b in views[i + 1:]:
            d = F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x - y))
            cols[f"{a}__{b}__same"] = F.col(a) == F.col(b)
            cols[f"{a}__{b}__mad"] = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size(d)
    return df.withColumns(cols)


def keyed_merge(loaded: DataFrame, reference: DataFrame, missing_regex: str, key: str = "key",
                value: str = "value") -> DataFrame:
    """Loaded keys present in the reference (cast to its type) ∪ reference keys matching the regex
    and absent from loaded. Other loaded keys are dropped.

    Both sides are ``(key, value, dtype)``; the cast is per row by the reference dtype name.
    """
    ref = reference.select(key, F.col(value).alias("_rv"), F.col("dtype").alias("_rt"))
    kept = loaded.select(key, value).join(ref, key, "inner")
    kept = kept.select(key, F.when(F.col("_rt") == "int", F.col(value).cast("bigint").cast("double"))
                       .otherwise(F.col(value).cast("double")).alias(value), F.col("_rt").alias("dtype"),
                       F.lit("loaded").alias("origin"))
    fill = ref.join(loaded.select(key), key, "left_anti").filter(F.col(key).rlike(f"^(?:{missing_regex})$"))
    fill = fill.select(key, F.col("_rv").alias(value), F.col("_rt").alias("dtype"), F.lit("reference").alias("origin"))
    return kept.unionByName(fill)


def stats_catalogue(frames: DataFrame, catalogue: DataFrame, asset: str = "asset_id", out: str = "stats") -> DataFrame:
    """Attach the stats of each row's asset as struct ``out``; one without stats fails the job.

    The check is part of the struct, so whoever reads the stats meets it.
    """
    fields = [c for c in catalogue.columns if c != asset]
    cat = catalogue.select(F.col(asset).alias("_asset"), F.struct(*fields).alias("_found"))
    j = join_small(frames.withColumn("_asset", F.col(asset)), cat, ["_asset"], "left").drop("_asset")
    none = F.raise_error(F.concat(F.lit("no norm stats for asset "), F.coalesce(F.col(asset).cast("string"), F.lit("null"))))
    return j.withColumn(out, F.when(F.col("_found").isNull(), none.cast(cat.schema["_found"].dataType))
                        .otherwise(F.col("_found"))).drop("_found")
