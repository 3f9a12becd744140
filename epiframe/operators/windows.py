"""Frame-order window operators.

Look-ahead/look-back windows go through ``plans.ordered.neighbours`` so a
long episode is split into fixed segments instead of one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiframe.functions import vectors as V
from epiframe.plans.ordered import frame_window, neighbours, running_agg
from epiframe.session import join_small


def action_chunk(df: DataFrame, horizon: int, cols: Sequence[str] = ("actions",),
                 keys: Sequence[str] = ("episode_id",), t: str = "t", segment: int | None = None) -> DataFrame:
    """Replace each column in ``cols`` by its next ``horizon`` values in the episode.

    Element ``i`` of row ``t`` is ``col[min(t+i, n-1)]``: the tail repeats the
    episode's last value and never reaches into another episode. Built from
    ``lead(col, i)`` offsets (one window pass); a missing lead falls back to
    the previous element, which is the clamp. A null action is an action.
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    if horizon == 1:
        return df.withColumns({c: F.array(F.col(c)) for c in cols})
    rows, w, finish = frame_window(df, list(keys), t, after=horizon - 1, segment=segment)
    # wrapped values: a missing lead is null, a lead that holds a null is not
    leads = {f"_lead_{c}_{i}": F.lead(F.struct(F.col(c).alias("v")), i).over(w) for c in cols for i in range(1, horizon)}
    rows = rows.withColumns(leads)
    out = {}
    for c in cols:
        elems = [F.struct(F.col(c).alias("v"))]
        for i in range(1, horizon):
            elems.append(F.coalesce(F.col(f"_lead_{c}_{i}"), elems[-1]))
        out[c] = F.array(*[e["v"] for e in elems])
    return finish(rows.withColumns(out).drop(*leads))


def chunk_weights(df: DataFrame, horizon: int, keys: Sequence[str] = ("episode_id",),
                  t: str = "t") -> DataFrame:
    """How many length-``horizon`` chunks hold each frame (trap 15: no chunk built).

    Row ``j < n-1`` is in ``min(j+1, H)`` chunks. The last row also fills the
    clamped tails: chunk ``s >= max(0, n-H)`` holds it ``s+H-n+1`` times.
    """
    lengths = df.groupBy(*keys).agg((F.max(t) + 1).alias("_n"))
    n, j, h = F.col("_n"), F.col(t), F.lit(horizon)
    a = F.greatest(F.lit(0), n - h)
    k = n - a
    first = a + h - n + 1
    last_w = (first + h) * k / 2
    out = join_small(df, lengths, list(keys))
    return out.withColumn("weight", F.when(j == n - 1, last_w).otherwise(F.least(j + 1, h)).cast("bigint")).drop("_n")


def next_frame(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("episode_id",), t: str = "t",
               prefix: str = "next_") -> DataFrame:
    """Values of the following frame in the same episode (null on the last), via ``lead``."""
    rows, w, finish = frame_window(df, list(keys), t, after=1)
    return finish(rows.withColumns({f"{prefix}{c}": F.lead(c, 1).over(w) for c in cols}))


def block_assign(df: DataFrame, horizon: int, t: str = "t") -> DataFrame:
    """Step → (block, offset) for replanning every ``horizon`` steps."""
    return df.withColumn("block", (F.col(t) / F.lit(horizon)).cast("bigint")).withColumn(
        "offset", (F.col(t) % F.lit(horizon)).cast("bigint"))


def chunk_replay(steps: DataFrame, plans: DataFrame, horizon: int, keys: Sequence[str] = ("episode_id",),
                 t: str = "t", chunk: str = "chunk") -> DataFrame:
    """J9 periodic case: step ``s`` takes row ``s % h`` of the chunk planned at step ``h*(s div h)``.

    ``plans`` has one row per replan step ``(keys, t, chunk)``. Equi-join on
    the block number — no per-episode state needed.
    """
    p = plans.select(*keys, (F.col(t) / F.lit(horizon)).cast("bigint").alias("block"), F.col(chunk).alias("_chunk"))
    s = block_assign(steps, horizon, t)
    return (s.join(p, [*keys, "block"], "left")
            .withColumn("action", F.get(F.col("_chunk"), F.col("offset").cast("int")))
            .drop("_chunk"))


def asof_replay(steps: DataFrame, plans: DataFrame, keys: Sequence[str] = ("episode_id",), t: str = "t",
                chunk: str = "chunk") -> DataFrame:
    """J9 irregular replans: latest plan at or before each step, row ``s - plan_t`` of its chunk.

    The plan step is a running max over steps and plans in time order
    (block-cut, so long episodes stay parallel); the chunk then comes from
    an equi-join on ``(keys, plan_t)`` — an as-of join without pairs.
    """
    k = list(keys)
    p = plans.select(*k, t, F.col(t).alias("_pt"), F.lit(0).alias("_kind"))
    s = steps.select(*k, t, F.lit(None).cast("bigint").alias("_pt"), F.lit(1).alias("_kind"))
    u = running_agg(p.unionByName(s), "_pt", [t, "_kind"], "plan_t", keys=k, agg="max")
    u = u.filter(F.col("_kind") == 1).drop("_pt", "_kind")
    pc = plans.select(*k, F.col(t).alias("plan_t"), F.col(chunk).alias("_c"))
    return (u.join(pc, [*k, "plan_t"], "left")
            .withColumn("offset", F.col(t) - F.col("plan_t"))
            .withColumn("action", F.get(F.col("_c"), F.col("offset").cast("int")))
            .drop("_c"))


def newest_only(df: DataFrame, channel: str = "channel", arrival: str | Sequence[str] = "arrival",
                ts: str = "ts") -> DataFrame:
    """Keep a reading only if its timestamp exceeds every one taken before it on its channel.

    "Taken before" = earlier arrival (one column or several); the running max
    is block-cut so a busy channel is not one task.
    """
    order = [arrival] if isinstance(arrival, str) else list(arrival)
    r = running_agg(df, ts, order, "_prev", keys=[channel], agg="max", include_current=False)
    return r.filter(F.col("_prev").isNull() | (F.col(ts) > F.col("_prev"))).drop("_prev")


def log_bucket(step, interval: int):
    """Step 0 alone, then 1..L, L+1..2L, … (flush when ``step % L == 0``)."""
    s = F.col(step) if isinstance(step, str) else step
    return F.ceil(s / F.lit(interval)).cast("bigint")
