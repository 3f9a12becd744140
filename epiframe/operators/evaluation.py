"""Evaluation and monitoring aggregates.

Exact medians/percentiles come from radix selection (``selection.select_quantiles``:
linear interpolation as numpy's default, only counts are shuffled);
``percentile_approx`` is the one-pass approximate choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions.vectors import l1_l2
from epiframe.operators.selection import select_quantiles
from epiframe.operators.windows import log_bucket, next_frame
from epiframe.plans.ordered import join_null_safe, neighbours

# Latency percentiles reported per metric.
LATENCY_PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def eval_pairs(frames: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("episode_id",), t: str = "t",
               strict_reference: bool = False, global_index: str = "gidx") -> DataFrame:
    """Pair each frame with the next one.

    Default: within the episode (the last frame has no partner). With
    ``strict_reference`` the pairing follows the global index and may cross
    an episode boundary, as ``dataset[idx + 1]`` does.
    """
    if not strict_reference:
        return next_frame(frames, cols, keys, t).filter(F.col(f"next_{cols[0]}").isNotNull())
    nxt = frames.select((F.col(global_index) - 1).alias(global_index),
                        *[F.col(c).alias(f"next_{c}") for c in cols])
    return frames.join(nxt, global_index)


def eval_samples(pairs: DataFrame, pred: str, target: str) -> DataFrame:
    """A5 per sample: L1 = mean |d|, L2 = sqrt(mean d²)."""
    l1, l2 = l1_l2(F.col(pred), F.col(target))
    return pairs.withColumn("l1", l1).withColumn("l2", l2)


def eval_summary(samples: DataFrame) -> DataFrame:
    """A5: count, mean, population std, median and max of L1 and L2 (exact median by radix selection).

    L1 and L2 are stacked into ``(metric, value)`` rows, aggregated per
    metric, joined to their medians on the metric and pivoted to one row.
    """
    long = samples.select(F.explode(F.array(
        F.struct(F.lit("l1").alias("metric"), F.col("l1").alias("value")),
        F.struct(F.lit("l2").alias("metric"), F.col("l2").alias("value")))).alias("m")).select("m.*")
    agg = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                     F.stddev_pop("value").alias("std"), F.max("value").alias("max"))
    med = select_quantiles(long, ["metric"], "value", [0.5], prefix="median_", few_groups=True)
    per = agg.join(med, "metric")
    wide = per.groupBy().pivot("metric", ["l1", "l2"]).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"),
        F.first("median_50").alias("median"), F.first("max").alias("max"))
    return wide.select(F.col("l1_n").alias("n"), *[f"{m}_{s}" for m in ("l1", "l2")
                                                     for s in ("mean", "std", "median", "max")])


def eval_per_dim(pairs: DataFrame, pred: str, target: str, labels: Sequence[str] | None = None) -> DataFrame:
    """A5: mean |d| per dimension, with optional labels."""
    d = pairs.select(F.posexplode(F.zip_with(F.col(pred), F.col(target), lambda a, b: F.abs(a - b))).alias("dim", "ad"))
    out = d.groupBy("dim").agg(F.avg("ad").alias("mean_abs_err"))
    if labels:
        out = out.withColumn("label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("dim")))
    return out.withColumn("dim", F.col("dim").cast("bigint"))


def latency_summary(df: DataFrame, metric: str = "metric", ms: str = "ms",
                    percentiles: Sequence[float] = LATENCY_PERCENTILES) -> DataFrame:
    """Per metric mean, population std and linearly interpolated percentiles (exact, by radix selection)."""
    g = df.groupBy(metric).agg(F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"))
    return join_null_safe(g, select_quantiles(df, [metric], ms, percentiles), [metric], "left")


def success_rollup(df: DataFrame, task: str = "task", success: str = "success") -> DataFrame:
    """Success rate and count per task plus the overall total (``rollup``)."""
    g = df.rollup(task).agg(F.avg(F.col(success).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"),
                            F.grouping_id().alias("level"))
    return g


def frame_qa(df: DataFrame, views: Sequence[str], allowed_sizes: Sequence[int], masks: Sequence[str] = ()) -> DataFrame:
    """A10: per view, images that are constant, of a wrong size, equal to an earlier view, or masked out; pixel moments; ``ok``.

    ``masks``: a boolean column per view (none: all there). A view is ``ok`` if nothing
    is wrong with any of its images. Views are stacked with one ``explode``; flags and
    pixel moments are aggregated map-side.
    """
    def twin(i: int):
        return F.coalesce(F.greatest(F.lit(False), F.lit(False), *[F.col(views[i]).eqNullSafe(F.col(v)) for v in views[:i]]), F.lit(False))

    there = [F.coalesce(F.col(m), F.lit(False)) for m in masks] or [F.lit(True)] * len(views)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("x"), twin(i).alias("twin"), there[i].alias("there"))
                                            for i, v in enumerate(views)])).alias("e")).select("e.*")
    per_image = stacked.groupBy("view").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.array_min("x") == F.array_max("x")).alias("n_constant"),
        F.count_if(F.col("x").isNull() | ~F.size("x").isin(*allowed_sizes)).alias("n_bad_size"),
        F.count_if("twin").alias("n_same"), F.count_if(~F.col("there")).alias("n_masked"),
        F.min(F.array_min("x")).alias("min"), F.max(F.array_max("x")).alias("max"))
    pixels = stacked.select("view", F.explode("x").alias("_p")).groupBy("view").agg(F.stddev_pop("_p").alias("std"))
    out = per_image.join(pixels, "view", "left")
    return out.withColumn("ok", F.col("n_constant") + F.col("n_bad_size") + F.col("n_same") + F.col("n_masked") == 0)


def log_extract(lines: DataFrame, text: str = "text") -> DataFrame:
    """Every ``step=<int> loss=<dec>`` match, in order → ``(line, match_no, step, loss)``."""
    pat = r"step=(\d+)\s+loss=([\d.]+)"
    steps = F.regexp_extract_all(F.col(text), F.lit(pat), 1)
    losses = F.regexp_extract_all(F.col(text), F.lit(pat), 2)
    z = lines.select("*", F.posexplode(F.arrays_zip(steps.alias("s"), losses.alias("l"))).alias("match_no", "_m"))
    return z.select(*lines.columns, F.col("match_no").cast("bigint"), F.col("_m.s").cast("bigint").alias("step"),
                    F.col("_m.l").cast("double").alias("loss"))


def log_interval(metrics: DataFrame, interval: int, step: str = "step", cols: Sequence[str] = ("loss",)) -> DataFrame:
    """Means per log window (step 0 alone, then 1..L, …)."""
    return metrics.groupBy(log_bucket(step, interval).alias("window")).agg(
        F.max(step).alias("last_step"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in cols])


def eta_text(seconds) -> F.Column:
    """``ETA=<h>h<mm>m``."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    h = F.floor(s / 3600).cast("bigint")
    m = F.floor((s % 3600) / 60).cast("bigint")
    return F.format_string("ETA=%dh%02dm", h, m)


def rollout_summary(df: DataFrame, success: str = "success", duration: str = "duration") -> DataFrame:
    """Rollouts with scores in [0, 1] only; mean score, mean duration, counts."""
    ok = F.col(success).cast("double").between(0.0, 1.0)
    return df.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok | F.col(success).isNull()).alias("n_invalid"),
                  F.avg(F.when(ok, F.col(success).cast("double"))).alias("mean_success"),
                  F.avg(F.when(ok, F.col(duration))).alias("mean_duration"))


def rate_last50(df: DataFrame, channel: str = "channel", ts: str = "ts", idx: str = "seq") -> DataFrame:
    """Per reading, ``(n - 1) / (max - min)`` of its channel's last 50 timestamps (itself included).

    ``idx`` is the dense 0-based reading number per channel; the 50-row
    look-back goes through ``neighbours`` (segments + halo), not a
    whole-channel window.
    """
    nb = neighbours(df, [channel], idx, [ts], before=49, out="_w")
    tss = F.transform("_w", lambda x: x[ts])
    n = F.size(tss)
    span = F.array_max(tss) - F.array_min(tss)
    return nb.withColumn("rate", F.when((n > 1) & (span > 0), (n - 1) / span)).drop("_w")


def success_running(df: DataFrame, task: str = "task", order: str = "episode", success: str = "success") -> DataFrame:
    """A7 running form: per task, successes and episodes so far and their ratio, in ``order``."""
    from epiframe.plans.ordered import running_agg

    d = df.withColumn("_s", F.col(success).cast("bigint")).withColumn("_one", F.lit(1).cast("bigint"))
    d = running_agg(d, "_s", [order], "successes", keys=[task], agg="sum")
    d = running_agg(d, "_one", [order], "episodes", keys=[task], agg="sum")
    return d.withColumn("rate", F.col("successes") / F.col("episodes")).drop("_s", "_one")
