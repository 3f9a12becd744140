"""Episode-level operators.

Per-episode facts (lengths, offsets) live in a small episode table made by
partial aggregation; frames get them back through an equi-join, never a
whole-episode window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.plans.ordered import running_sum
from epiframe.session import join_small

# Fixed layout of the 31-dim vector: modality name and the slice taken from it, in order.
MODALITY_LAYOUT = (("eef_torso", 0, 9), ("head", 0, 2), ("eef_left", 0, 9), ("gripper_cmd", 0, 1),
                   ("eef_right", 0, 9), ("gripper_cmd", 1, 1))


def modality_concat(tables: Mapping[str, DataFrame], keys: Sequence[str] = ("episode_id", "t"),
                    layout=MODALITY_LAYOUT, out: str = "state") -> DataFrame:
    """Bring per-modality tables ``(episode_id, t, v)`` together and concatenate slices.

    Frames that lack a modality are left out. The tables are stacked with a tag, dealt
    out by the keys as they are, and grouped where they lie: one shuffle for all of
    them, no join and no sort before it (a tag's rows are one a key, so that adding up
    before the shuffle would only widen them).
    """
    k = list(keys)
    names = list(dict.fromkeys(m for m, _, _ in layout))
    stacked = None
    for m in names:
        df = tables[m].select(*k, F.lit(names.index(m)).cast("tinyint").alias("_tag"), "v")
        stacked = df if stacked is None else stacked.unionByName(df)
    per = stacked.repartition(*k).groupBy(*k).agg(*[
        F.first(F.when(F.col("_tag") == n, F.struct("v")), ignorenulls=True).alias(f"_{m}") for n, m in enumerate(names)])
    for m in names:
        per = per.filter(F.col(f"_{m}").isNotNull())
    return per.select(*k, F.concat(*[F.slice(F.col(f"_{m}.v"), start + 1, size) for m, start, size in layout]).alias(out))


def modality_lengths(tables: Mapping[str, DataFrame], episode: str = "episode_id") -> DataFrame:
    """A8 input: ``(episode, modality, n)`` rows for every modality table."""
    out = None
    for m, df in tables.items():
        c = df.groupBy(episode).agg(F.count(F.lit(1)).alias("n")).withColumn("modality", F.lit(m))
        out = c if out is None else out.unionByName(c)
    return out


def length_check(lengths: DataFrame, episode: str = "episode_id") -> DataFrame:
    """``(episode, min_len, max_len, equal)`` across modalities."""
    return lengths.groupBy(episode).agg(F.min("n").alias("min_len"), F.max("n").alias("max_len")).withColumn(
        "equal", F.col("min_len") == F.col("max_len"))


def align_shortest(frames: DataFrame, lengths: DataFrame, episode: str = "episode_id", t: str = "t") -> DataFrame:
    """Cut every episode to its shortest modality (``t < min_len``)."""
    mins = lengths.groupBy(episode).agg(F.min("n").alias("_min"))
    return join_small(frames, mins, [episode]).filter(F.col(t) < F.col("_min")).drop("_min")


def downsample(frames: DataFrame, rate: int, t: str = "t") -> DataFrame:
    """P10: every ``rate``-th frame from 0, re-indexed ``t div rate``."""
    if rate <= 1:
        return frames
    return frames.filter(F.col(t) % rate == 0).withColumn(t, (F.col(t) / F.lit(rate)).cast("bigint"))


def downsampled_length(n, rate: int):
    """len(range(0, n, rate)) = ceil(n / rate); effective fps = fps // rate."""
    c = F.col(n) if isinstance(n, str) else n
    return F.ceil(c / F.lit(rate)).cast("bigint")


def min_length(frames: DataFrame, min_frames: int, episode: str = "episode_id") -> DataFrame:
    """Drop episodes with fewer than ``min_frames`` frames (aggregate + semi-join)."""
    ok = frames.groupBy(episode).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_frames).select(episode)
    return join_small(frames, ok, [episode], "left_semi")


def episode_table(frames: DataFrame, order: Sequence[str] = ("episode_id",), episode: str = "episode_id") -> DataFrame:
    """``(episode, length, offset)``, offsets = frames of all earlier episodes in ``order``."""
    lens = frames.groupBy(*dict.fromkeys([episode, *order])).agg(F.count(F.lit(1)).alias("length"))
    run = running_sum(lens, "length", list(order), out="_cum")
    return run.withColumn("offset", (F.col("_cum") - F.col("length")).cast("bigint")).drop("_cum")


def global_to_local(idx: DataFrame, episodes: DataFrame, col: str = "idx", episode: str = "episode_id",
                    bucket: int = 1024) -> DataFrame:
    """Global frame index → (episode, local index) with ``offset <= idx < offset + length``.

    Range join as an equi-join on ``idx div bucket``: each episode is listed
    under every bucket its range touches, so no nested-loop join is needed.
    """
    b = F.lit(bucket)
    ep = episodes.select(episode, "offset", "length").filter(F.col("length") > 0).withColumn(
        "_b", F.explode(F.sequence((F.col("offset") / b).cast("bigint"),
                                   ((F.col("offset") + F.col("length") - 1) / b).cast("bigint"))))
    i = idx.withColumn("_b", (F.col(col) / b).cast("bigint"))
    j = i.join(ep, "_b").filter((F.col(col) >= F.col("offset")) & (F.col(col) < F.col("offset") + F.col("length")))
    return j.withColumn("local", (F.col(col) - F.col("offset")).cast("bigint")).drop("_b", "offset", "length")


def reject_split(episodes: DataFrame, rules: Mapping[str, object], episode: str = "episode_id"):
    """K7: ``(good, rejects)``; ``rules`` maps a reason to a boolean Column that marks a reject.

    The first matching reason wins (rules are checked in order).
    """
    reason = F.lit(None).cast("string")
    for name, cond in reversed(list(rules.items())):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    tagged = episodes.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).drop("reason")
    rejects = tagged.filter(F.col("reason").isNotNull()).select(episode, "reason")
    return good, rejects


def reject_report(rejects: DataFrame) -> DataFrame:
    """K7: count per reason."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def movement_filter(frames: DataFrame, col: str = "movement_enabled") -> DataFrame:
    """Drop steps with ``movement_enabled = false``; missing column or null counts as true."""
    if col not in frames.columns:
        return frames
    return frames.filter(F.coalesce(F.col(col), F.lit(True)))


def truncate_on_failure(frames: DataFrame, failed: str, episode: str = "episode_id", t: str = "t") -> DataFrame:
    """Stop each episode at its first failed step (the failed step is dropped too).

    The first failure per episode comes from a partial aggregate, so no
    running window over the episode is needed.
    """
    first = frames.filter(F.col(failed)).groupBy(episode).agg(F.min(t).alias("_first_fail"))
    j = join_small(frames, first, [episode], "left")
    return j.filter(F.col("_first_fail").isNull() | (F.col(t) < F.col("_first_fail"))).drop("_first_fail")


def episode_best(steps: DataFrame, episode: str = "episode_id", reward: str = "reward", done: str = "done") -> DataFrame:
    """Best reward and whether the episode ever finished."""
    return steps.groupBy(episode).agg(F.max(reward).alias("best_reward"), F.bool_or(done).alias("done"))


def running_best(steps: DataFrame, episode: str = "episode_id", t: str = "t", reward: str = "reward") -> DataFrame:
    """A16 running form: best reward so far (running max; episodes are block-cut)."""
    from epiframe.plans.ordered import running_agg

    return running_agg(steps, reward, [t], "best_so_far", keys=[episode], agg="max")


def filter_success(episodes: DataFrame, path: str = "file_path") -> DataFrame:
    """Keep episodes whose whole file path matches ``.*success.*``."""
    return episodes.filter(F.col(path).rlike("^(?s).*success.*$"))


def restructure(df: DataFrame, action_space: str = "joint_position", gripper: str = "gripper_position",
                out: str = "actions") -> DataFrame:
    """action = joint positions *or* joint velocities (chosen when the plan is built) ++ gripper."""
    if action_space not in ("joint_position", "joint_velocity"):
        raise ValueError(f"unknown action space {action_space!r}")
    return df.withColumn(out, F.concat(F.col(action_space).cast("array<double>"),
                                       F.col(gripper).cast("array<double>")))
