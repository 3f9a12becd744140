"""The training read path as one plan: chunk, keep-range filter, mix, shuffle, batch.

Chunks are built on all frames of an episode before the filter, so that a kept frame's
chunk may reach into dropped ones. Sources are mixed by weight, each repeated as often
as its share needs; places in the shuffled order are a keyed permutation of the mixed
slots, so shuffling moves nothing; a batch is a run of places, the incomplete last one
is left out.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.operators import ranges as RG
from epiframe.operators import sampling as SM
from epiframe.operators import windows as W
from epiframe.plans.ordered import join_null_safe
from epiframe.session import checkpoint_dir


@dataclasses.dataclass(frozen=True)
class Source:
    """Frames of one dataset, its share of the samples, and what to keep of it (None: all)."""

    frames: DataFrame
    weight: float
    ranges: DataFrame | None = None


def kept_frames(source: Source, keys: Sequence[str] = ("episode_id",), t: str = "t") -> DataFrame:
    """``(keys, t)`` of the frames that pass the source's keep ranges."""
    frames = source.frames.select(*keys, t)
    return frames if source.ranges is None else RG.range_sweep_join(frames, source.ranges, keys, t)


def read_path(spark: SparkSession, sources: Mapping[str, Source], horizon: int, samples: int, batch_size: int, seed: int = 0,
              epoch: int = 0, buffer: int | None = None, actions: str = "actions", keys: Sequence[str] = ("episode_id",),
              t: str = "t") -> DataFrame:
    """``samples`` mixed samples as rows (batch, pos, source, the source's columns); see the module."""
    if samples < batch_size:
        raise ValueError(f"{samples} samples, fewer than batch size {batch_size}")
    checkpoint_dir(spark)
    k = [*keys, t]
    # only keys are numbered, mixed and placed; chunks are joined to the samples at the end
    rows = {name: kept_frames(s, keys, t).checkpoint() for name, s in sources.items()}
    mixed = SM.weighted_mix(spark, rows, {name: s.weight for name, s in sources.items()}, samples, k, seed=seed)
    placed = SM.shuffle_dense(mixed, "slot", samples, seed, epoch, buffer)
    full = placed.filter(F.col("pos") < samples // batch_size * batch_size)
    full = full.withColumn("batch", F.floor(F.col("pos") / F.lit(batch_size)).cast("bigint")).drop("slot")
    chunks = None
    for name, s in sources.items():
        c = W.action_chunk(s.frames, horizon, [actions], keys=keys, t=t).withColumn("source", F.lit(name))
        chunks = c if chunks is None else chunks.unionByName(c, allowMissingColumns=True)
    return join_null_safe(full, chunks, ["source", *k])
