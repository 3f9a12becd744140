"""Idle detection and keep ranges.

Runs (gaps-and-islands) are found without a per-episode scan: inside each
(episode, flag) group the island of a frame is ``t - index_within(...)``,
and ``index_within`` cuts episodes into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.plans.ordered import frame_window, index_within, join_null_safe, running_agg
from epiframe.session import join_small

# Fixed values of the idle filter.
IDLE_EPS = 1e-3        # every dim of v(t) - v(t-1) strictly below this → idle
MIN_IDLE_LEN = 7       # idle runs at least this long are removed
MIN_KEEP_LEN = 16      # remaining runs at least this long are kept
TRIM_END = 10          # kept range end is shortened by this many frames


def idle_flag(df: DataFrame, col: str, keys: Sequence[str] = ("episode_id",), t: str = "t",
              eps: float = IDLE_EPS, out: str = "idle") -> DataFrame:
    """``all(|v(t) - v(t-1)| < eps)``; the first frame is never idle."""
    rows, w, finish = frame_window(df, list(keys), t, before=1)
    rows = rows.withColumn("_prev", F.lag(col, 1).over(w))
    still = F.forall(F.zip_with(F.col(col), F.col("_prev"), lambda a, b: F.abs(a - b) < F.lit(eps)), lambda x: x)
    flag = F.when(F.col("_prev").isNull(), F.lit(False)).otherwise(F.coalesce(still, F.lit(False)))
    return finish(rows.withColumn(out, flag).drop("_prev"))


def runs(df: DataFrame, flag: str, keys: Sequence[str] = ("episode_id",), t: str = "t") -> DataFrame:
    """Maximal runs of equal ``flag``: ``(keys, flag, island, start, end, len)`` with end exclusive."""
    k = list(keys)
    idx = index_within(df.select(*k, t, flag), [*k, flag], [t], out="_k")
    isl = idx.withColumn("island", F.col(t) - F.col("_k"))
    return isl.groupBy(*k, flag, "island").agg(
        F.min(t).alias("start"), (F.max(t) + 1).alias("end"), F.count(F.lit(1)).alias("len"))


def with_run_length(df: DataFrame, flag: str, keys: Sequence[str] = ("episode_id",), t: str = "t",
                    out: str = "run_len") -> DataFrame:
    """Attach the length of the run each frame belongs to (equi-join on the island id)."""
    k = list(keys)
    idx = index_within(df, [*k, flag], [t], out="_k").withColumn("island", F.col(t) - F.col("_k"))
    lens = idx.groupBy(*k, flag, "island").agg(F.count(F.lit(1)).alias(out))
    return idx.join(lens, [*k, flag, "island"]).drop("_k", "island")


def nonidle_ranges(df: DataFrame, col: str, keys: Sequence[str] = ("episode_id",), t: str = "t",
                   min_idle: int = MIN_IDLE_LEN, min_keep: int = MIN_KEEP_LEN,
                   trim_end: int = TRIM_END, eps: float = IDLE_EPS) -> DataFrame:
    """``(keys, start, end)`` keep ranges; episodes with none get one row of nulls.

    Round 1 removes idle runs of length ``>= min_idle``; round 2 keeps
    remaining runs of length ``>= min_keep`` as ``[start, end - trim_end)``.
    """
    k = list(keys)
    fl = idle_flag(df.select(*k, t, col), col, k, t, eps)
    r = runs(fl.select(*k, t, "idle"), "idle", k, t).withColumn("_out", F.col("idle") & (F.col("len") >= min_idle))
    # runs tile the episode: what lies between two removed runs is one range
    r = running_agg(r, F.col("_out").cast("bigint"), ["start"], "_cut", keys=k)
    r = r.filter(~F.col("_out")).groupBy(*k, "_cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    r = r.filter(F.col("end") - F.col("start") >= min_keep)
    ranges = r.select(*k, F.col("start").cast("bigint"), (F.col("end") - trim_end).cast("bigint").alias("end"))
    return join_null_safe(df.select(*k).distinct(), ranges, k, "left")


def keep_ranges_json(ranges: DataFrame, keys: Sequence[str] = ("episode_id",), per_line: int = 1000) -> DataFrame:
    """K4: JSON lines ``(episode_key, part, ranges=[[s,e],…])`` in start order, at most ``per_line`` ranges each.

    An episode with many ranges spans several lines (``part`` 0, 1, …), so no
    line — and no task — holds an unbounded list. Episodes without ranges
    get one line with ``[]``.
    """
    k = list(keys)
    has = ranges.filter(F.col("start").isNotNull())
    num = index_within(has, k, ["start"], out="_i").withColumn("part", (F.col("_i") / F.lit(per_line)).cast("bigint"))
    g = num.groupBy(*k, "part").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r"))
    none = ranges.filter(F.col("start").isNull()).select(*k, F.lit(0).cast("bigint").alias("part"),
                                                         F.array().cast(g.schema["_r"].dataType).alias("_r"))
    g = g.unionByName(none)
    arr = F.transform("_r", lambda r: F.array(r["start"], r["end"]))
    key = F.concat_ws("--", *[F.col(c).cast("string") for c in k])
    return g.select(key.alias("episode_key"), "part", F.to_json(arr).alias("ranges"))


def read_keep_ranges(df: DataFrame, key_col: str = "episode_key", ranges_col: str = "ranges") -> DataFrame:
    """S11 (line form): parse ``ranges`` JSON and explode to ``(episode_key, start, end)``."""
    arr = F.from_json(ranges_col, "array<array<int>>")
    e = df.select(key_col, F.explode(arr).alias("_r"))
    return e.select(key_col, F.get("_r", 0).cast("bigint").alias("start"), F.get("_r", 1).cast("bigint").alias("end"))


def read_keep_ranges_map(df: DataFrame, col: str = "value") -> DataFrame:
    """S11 (document form): ``{episode_key: [[s,e],…], …}`` per row → ``(episode_key, start, end)``."""
    m = F.from_json(col, "map<string, array<array<int>>>")
    e = df.select(F.explode(m).alias("episode_key", "_rs")).select("episode_key", F.explode("_rs").alias("_r"))
    return e.select("episode_key", F.get("_r", 0).cast("bigint").alias("start"), F.get("_r", 1).cast("bigint").alias("end"))


def keep_ranges_document(ranges: DataFrame, keys: Sequence[str] = ("episode_id",), per_line: int = 1000) -> DataFrame:
    """K4: the one JSON document ``{"<episode>": [[s,e], ...], ...}`` as lines ``(place, episode_key, part, value)``.

    The lines in order of (place, episode_key, part), one after another, are the document:
    a head, the episodes by key, a tail. An episode of many ranges goes on over several lines,
    so that no row and no task holds more than ``per_line`` ranges; ``write_document`` keeps the order.
    """
    lines = keep_ranges_json(ranges, keys, per_line)
    last = lines.groupBy("episode_key").agg(F.max("part").alias("_last"))
    first = lines.agg(F.min(F.struct("episode_key", "part")).alias("f"))
    d = lines.join(last, "episode_key").withColumn("_first", first.scalar())
    start = F.when(F.struct("episode_key", "part") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    name = F.to_json(F.array("episode_key"))
    opening = F.when(F.col("part") == 0, F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(": ["))).otherwise(F.lit(""))
    inner = F.substr("ranges", F.lit(2), F.length("ranges") - 2)
    closing = F.when(F.col("part") == F.col("_last"), F.lit("]")).otherwise(F.lit(""))
    body = d.select(F.lit(1).alias("place"), "episode_key", "part", F.concat(start, opening, inner, closing).alias("value"))
    ends = ranges.sparkSession.createDataFrame([(0, None, None, "{"), (2, None, None, "}")],
                                               "place int, episode_key string, part long, value string")
    return body.unionByName(ends)


def coalesce_ranges(ranges: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Overlapping and touching ranges of a key as one: ``(keys, start, end)``, by a sweep over the starts.

    A range begins a new one if it starts after every end before it (a running maximum,
    cut into blocks, so that a key of very many ranges is not one task). Empty ranges go.
    """
    k = list(keys)
    r = ranges.filter(F.col("start").isNotNull() & (F.col("end") > F.col("start"))).select(*k, "start", "end")
    r = running_agg(r, "end", ["start", "end"], "_reach", keys=k, agg="max", include_current=False)
    r = r.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("bigint"))
    r = running_agg(r, "_new", ["start", "end"], "_group", keys=k)
    return r.groupBy(*k, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def range_sweep_join(frames: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("episode_id",), t: str = "t") -> DataFrame:
    """J2 for ranges of any length and overlap: keep frame iff ``start <= t < end`` for a range of its episode.

    Starts and frames stand in one order; a frame is kept iff the furthest end among the
    starts up to it lies beyond it. No range is listed, cut or repeated. Null keys match null.
    """
    k = list(keys)
    r = ranges.filter(F.col("start").isNotNull() & (F.col("end") > F.col("start"))).select(
        *k, F.col("start").cast(frames.schema[t].dataType).alias(t), F.col("end").cast("bigint").alias("_end"), F.lit(0).alias("_kind"))
    both = frames.withColumns({"_end": F.lit(None).cast("bigint"), "_kind": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    swept = running_agg(both, "_end", [t, "_kind"], "_reach", keys=k, agg="max")
    return swept.filter((F.col("_kind") == 1) & (F.col(t) < F.col("_reach"))).select(*frames.columns)


def range_semi_join(frames: DataFrame, ranges: DataFrame | None, keys: Sequence[str] = ("episode_id",),
                    t: str = "t", exploded: bool = False, bucket: int = 1024) -> DataFrame:
    """Keep frame iff ``start <= t < end`` for a range of its episode.

    No ranges table → keep all; unknown episode → dropped. Default: each
    range is listed under every ``t div bucket`` it touches and frames
    semi-join on ``(episode, t div bucket)`` plus the range condition, so a
    frame only meets the few ranges of its own bucket (no episode-wide pair
    scan, a hot episode spreads over its buckets); AQE broadcasts the ranges
    when they are small. ``exploded``: ranges become frame keys and the
    semi-join is a pure equi-join on ``(episode, t)``.
    """
    if ranges is None:
        return frames
    k = list(keys)
    r = ranges.filter(F.col("start").isNotNull() & (F.col("end") > F.col("start"))).select(
        *[F.col(c).alias(f"_r_{c}") for c in k], F.col("start").alias("_s"), F.col("end").alias("_e"))
    if exploded:
        keys_df = r.select(*[F.col(f"_r_{c}").alias(c) for c in k],
                           F.explode(F.sequence("_s", F.col("_e") - 1)).alias(t)).distinct()
        return frames.join(keys_df, [*k, t], "left_semi")
    b = F.lit(bucket)
    rb = r.withColumn("_rb", F.explode(F.sequence((F.col("_s") / b).cast("bigint"),
                                                  ((F.col("_e") - 1) / b).cast("bigint"))))
    fb = frames.withColumn("_fb", (F.col(t) / b).cast("bigint"))
    cond = [fb[c] == rb[f"_r_{c}"] for c in k] + [fb["_fb"] == rb["_rb"], fb[t] >= rb["_s"], fb[t] < rb["_e"]]
    return fb.join(rb, cond, "left_semi").drop("_fb")


def resume_anti_join(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Episodes not yet in the existing result (restart without redoing work)."""
    d = done.select(*keys).distinct()
    return join_small(todo, d, list(keys), "left_anti")
