"""Normalisation statistics (A1–A4, K3, J6, J12, M1–M4 application).

Stats are computed on a long table ``(key, dim, x)`` of every vector
element. Both passes aggregate map-side first, so only ``(key, dim)`` or
``(key, dim, bin)`` partial states cross the shuffle, however skewed the
input is.

Quantiles follow a 5000-bin histogram over ``[min-1e-10, max+1e-10]``: the
answer is the left edge of the first bin whose cumulative count reaches
``q * n``. Ours is exact two-pass (range first, then counts), not the
single-pass re-binning approximation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from epiframe.functions import vectors as V
from epiframe.session import join_small

# Fixed values of the histogram quantiles: bins, range padding, reported quantiles.
NUM_BINS = 5000
RANGE_PAD = 1e-10
QUANTILES = (0.01, 0.99)


def long_values(df: DataFrame, vector_cols: Sequence[str] = (), chunk_cols: Sequence[str] = ()) -> DataFrame:
    """``(key, dim, x)`` for every element; chunk columns contribute every row of every chunk.

    One pass over ``df``: the per-row entries are built as one array and
    exploded once.
    """
    parts = [F.array(F.struct(F.lit(c).alias("key"), F.col(c).cast("array<double>").alias("v")))
             for c in vector_cols]
    parts += [F.transform(F.col(c), _keyed_row(c)) for c in chunk_cols]
    if not parts:
        raise ValueError("no columns given")
    entries = parts[0] if len(parts) == 1 else F.concat(*parts)
    e = df.select(F.explode(entries).alias("e"))
    return e.select(F.col("e.key").alias("key"), F.posexplode("e.v").alias("dim", "x")).withColumn(
        "dim", F.col("dim").cast("bigint"))


def _keyed_row(key: str):
    return lambda r: F.struct(F.lit(key).alias("key"), r.cast("array<double>").alias("v"))


def moments(values: DataFrame) -> DataFrame:
    """A1+A2: count, mean, population std, min, max per (key, dim)."""
    return values.groupBy("key", "dim").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))


def histogram_quantiles(values: DataFrame, ranges: DataFrame, quantiles: Sequence[float] = QUANTILES,
                        bins: int = NUM_BINS, carry: Sequence[str] = ()) -> DataFrame:
    """A3 second pass: per (key, dim) the left bin edge reaching each quantile.

    ``ranges`` holds one row per (key, dim) with ``min``, ``max``, ``count`` —
    at most keys × dims rows, so it is broadcast. Columns in ``carry`` (e.g.
    the moments) ride along on the broadcast rows and come out unchanged,
    so the first pass is never evaluated twice.
    """
    r = ranges.select("key", "dim", *carry, (F.col("min") - F.lit(RANGE_PAD)).alias("lo"),
                      (F.col("max") + F.lit(RANGE_PAD)).alias("hi"), F.col("count").alias("n"))
    v = join_small(values, r, ["key", "dim"], known_small=True)
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))))
    group = ["key", "dim", *carry, "lo", "hi", "n"]
    hist = v.groupBy(*group, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("key", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("cum", F.sum("c").over(w))
    aggs = []
    for q in quantiles:
        first = F.min(F.when(F.col("cum") >= F.lit(q) * F.col("n"), F.col("bin")))
        aggs.append(first.alias(f"_b{_qname(q)}"))
    out = hist.groupBy(*group).agg(*aggs)
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return out.select("key", "dim", *carry, *[(F.col(f"_b{_qname(q)}") * step + F.col("lo")).alias(_qname(q))
                                              for q in quantiles])


def _qname(q: float) -> str:
    return f"q{round(q * 100):02d}"


def norm_stats(values: DataFrame, quantiles: Sequence[float] = QUANTILES, bins: int = NUM_BINS,
               min_count: int = 2) -> DataFrame:
    """A1–A3: ``(key, dim, count, mean, std, min, max, q01, q99)`` in two passes over ``values``.

    Pass 1 (moments, map-side partial aggregation) is broadcast to pass 2
    (histogram); the moments ride along, so there is no third pass. Fewer
    than ``min_count`` vectors for a key is an error in the result
    (``raise_error`` in the plan, no driver round trip).
    """
    m = moments(values)
    out = histogram_quantiles(values, m, quantiles, bins, carry=["count", "mean", "std", "min", "max"])
    error = F.raise_error(F.lit(f"Cannot compute statistics for less than {min_count} vectors."))

    def checked(c: str):  # in every value: a column nobody reads is pruned with its check
        return F.when(F.col("count") >= min_count, F.col(c)).otherwise(error.cast(out.schema[c].dataType)).alias(c)

    return out.select("key", "dim", *[checked(c) for c in out.columns if c not in ("key", "dim")])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float],
                    prefix: str = "p") -> DataFrame:
    """Exact linearly interpolated quantiles per group (numpy's default), without one task per group.

    Equal values are counted first, so ties are one row. A running sum of the
    counts in value order tells which ranks a value covers; the values at the
    ranks below and above position ``q * (n - 1)`` each contribute ``value *
    weight`` (``1 - frac`` and ``frac``). A null key is a group like others.
    """
    from epiframe.plans.ordered import join_null_safe, running_agg

    k = list(keys)
    base = df.select(*k, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    counts = base.groupBy(*k, "_x").agg(F.count(F.lit(1)).alias("_c"))
    n = base.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_agg(counts, "_c", ["_x"], "_upto", keys=k)
    # group sizes: a join on the keys, or one scalar subquery for the whole input
    ranked = join_null_safe(ranked, n, k) if k else ranked.withColumn("_n", n.select("_n").scalar())

    def covers(rank):
        return (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))

    parts = []
    for q in quantiles:
        pos = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        lo, hi = F.floor(pos), F.ceil(pos)
        frac = pos - lo
        w = (F.when(covers(lo), F.lit(1.0) - frac).otherwise(F.lit(0.0))
             + F.when(covers(hi) & (hi != lo), frac).otherwise(F.lit(0.0)))
        parts.append(F.struct(F.lit(float(q)).alias("q"), w.alias("w")))
    e = ranked.select(*k, "_x", F.filter(F.array(*parts), lambda p: p["w"] > 0).alias("_w"))
    e = e.filter(F.size("_w") > 0).select(*k, "_x", F.explode("_w").alias("c"))
    sums = e.groupBy(*k, F.col("c.q").alias("q")).agg(F.sum(F.col("_x") * F.col("c.w")).alias("_v"))
    out = sums.groupBy(*k).pivot("q", [float(q) for q in quantiles]).agg(F.first("_v"))
    return out.select(*k, *[F.col(f"`{float(q)}`").alias(f"{prefix}{round(q * 100)}") for q in quantiles])


def stats_rows(stats: DataFrame) -> DataFrame:
    """Re-nest long stats to one row per key with dim-ordered arrays (mean, std, q01, q99)."""
    fields = ["mean", "std", "q01", "q99"]
    g = stats.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("dim", *fields))).alias("_s"))
    return g.select("key", *[F.transform("_s", V.field(f)).alias(f) for f in fields])


def stats_json(stats: DataFrame) -> DataFrame:
    """K3: one row ``{"norm_stats": {key: {mean, std, q01, q99}}}`` as a JSON string."""
    rows = stats_rows(stats)
    one = rows.select(F.lit(1).alias("_g"), F.struct("key", F.struct("mean", "std", "q01", "q99").alias("s")).alias("e"))
    m = one.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.key"), F.col("e.s")))).alias("m"))
    return m.select(F.to_json(F.struct(F.col("m").alias("norm_stats"))).alias("json"))


STATS_JSON_SCHEMA = "struct<norm_stats: map<string, struct<mean: array<double>, std: array<double>, " \
                    "q01: array<double>, q99: array<double>>>>"


def stats_from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """K3 read side: JSON rows → long ``(key, dim, mean, std, q01, q99)``."""
    parsed = df.select(F.explode(F.from_json(col, STATS_JSON_SCHEMA)["norm_stats"]).alias("key", "s"))
    z = parsed.select("key", F.arrays_zip("s.mean", "s.std", "s.q01", "s.q99").alias("z"))
    return z.select("key", F.posexplode("z").alias("dim", "r")).select(
        "key", F.col("dim").cast("bigint"), F.col("r.mean").alias("mean"), F.col("r.std").alias("std"),
        F.col("r.q01").alias("q01"), F.col("r.q99").alias("q99"))


def save_stats(stats: DataFrame, path: str) -> None:
    stats_json(stats).coalesce(1).write.mode("overwrite").text(path)


def load_stats(spark, path: str) -> DataFrame:
    return stats_from_json(spark.read.text(path).withColumnRenamed("value", "json"))


def _stats_fn(mode: str, inverse: bool, s):
    """One-argument column function (``transform`` counts lambda parameters)."""
    if mode == "z":
        return (lambda v: V.unnormalize_z(v, s["mean"], s["std"])) if inverse else \
            (lambda v: V.normalize_z(v, s["mean"], s["std"]))
    if mode == "quantile":
        return (lambda v: V.unnormalize_q(v, s["q01"], s["q99"])) if inverse else \
            (lambda v: V.normalize_q(v, s["q01"], s["q99"]))
    raise ValueError(mode)


def _applied(mode: str, inverse: bool, is_chunk: bool, missing):
    """Two-argument column function of a column and its stats; where these are null, ``missing`` or the column itself."""

    def new(x, s):
        fn = _stats_fn(mode, inverse, s)
        return F.when(s.isNull(), x if missing is None else missing).otherwise(V.on_rows(x, fn) if is_chunk else fn(x))

    return new


def apply_stats(df: DataFrame, stats: DataFrame, cols: Mapping[str, str], mode: str = "z",
                inverse: bool = False, strict: bool = False) -> DataFrame:
    """J6 + M1–M4: normalise (or invert) each column with the stats of key ``cols[col]``.

    ``stats`` (long form) is re-nested to ``map<key, struct<mean, std, q01,
    q99>>`` and attached as one scalar subquery: computed once, shipped to
    every task as a value (no join, no driver round trip). A column whose key
    has no stats is left unchanged, unless ``strict`` or ``inverse``, where
    the job fails.
    """
    rows = stats_rows(stats)
    table = rows.select(F.map_from_entries(F.collect_list(F.struct(
        "key", F.struct("mean", "std", "q01", "q99"))).alias("m"))).scalar()
    out = df
    for n, (col, key) in enumerate(cols.items()):
        # the subquery value becomes a column first: lambdas cannot hold subqueries
        out = out.withColumn(f"_stats{n}", table[F.lit(key)])
        is_chunk = isinstance(df.schema[col].dataType.elementType, ArrayType)
        missing = F.raise_error(F.lit(f"no norm stats for key {key!r}")).cast(df.schema[col].dataType) if strict or inverse else None
        new = V.once(_applied(mode, inverse, is_chunk, missing), col, f"_stats{n}")
        out = out.withColumn(col, new).drop(f"_stats{n}")
    return out


def norm_stats_pipeline(frames: DataFrame, horizon: int, delta_mask: Sequence[bool] | None,
                        state: str = "state", actions: str = "actions",
                        keys: Sequence[str] = ("episode_id",), t: str = "t") -> DataFrame:
    """A4: chunk → delta → stats of ``state`` (per frame) and ``actions`` (every chunk row).

    Chunks never become rows: see ``vector_stats.chunk_stats``.
    """
    from epiframe.operators.vector_stats import chunk_stats

    return chunk_stats(frames, horizon, delta_mask, state, actions, keys, t)


def weighted_values(frames: DataFrame, horizon: int, state: str = "state", actions: str = "actions",
                    keys: Sequence[str] = ("episode_id",), t: str = "t") -> DataFrame:
    """Chunk-free stats input when no delta applies: ``(key, dim, x, w)``."""
    from epiframe.operators.windows import chunk_weights

    w = chunk_weights(frames.select(*keys, t, state, actions), horizon, keys, t)
    e = F.array(F.struct(F.lit(state).alias("key"), F.col(state).alias("v"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.lit(actions).alias("key"), F.col(actions).alias("v"), F.col("weight").alias("w")))
    x = w.select(F.explode(e).alias("e"))
    return x.select(F.col("e.key").alias("key"), F.col("e.w").alias("w"),
                    F.posexplode("e.v").alias("dim", "x")).withColumn("dim", F.col("dim").cast("bigint"))


def weighted_moments(values: DataFrame) -> DataFrame:
    """A1 with integer weights: count, mean, population std, min, max."""
    g = values.groupBy("key", "dim").agg(
        F.sum("w").alias("count"), F.sum(F.col("x") * F.col("w")).alias("_s"),
        F.sum(F.col("x") * F.col("x") * F.col("w")).alias("_s2"), F.min("x").alias("min"), F.max("x").alias("max"))
    mean = F.col("_s") / F.col("count")
    return g.select("key", "dim", "count", mean.alias("mean"),
                    F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("count") - mean * mean)).alias("std"),
                    "min", "max")
