"""Statistics straight on vector columns: no element ever becomes a row.

Arrow batches of vectors are read as matrices inside tasks; what leaves a task is one
row per (key, dim). Two forms:

* ``growing_stats``: one pass, with histograms whose bin width is a power of two and
  doubles as the range grows. Bins lie on one grid for all tasks and micro-batches, so a
  finer histogram turns into a coarser one exactly, and partial results merge exactly
  in any order;
* ``chunk_stats``: A4, the stats of states and of the rows of (delta) action chunks.
  Chunks are gathered inside the task: dims without delta count every frame once with
  the number of chunk rows that hold it, only delta dims go through the offsets.

Missing values (null vectors, null elements, NaN) are left out; so are infinite ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators.stats import NUM_BINS, QUANTILES, RANGE_PAD, _qname
from epiframe.plans.ordered import frame_window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Exponents a bin width may have, and bits of a double's fraction.
EXPONENTS, FRACTION = (-300, 300), 52
_MOMENTS = "key string, dim long, n long, mean double, m2 double, min double, max double"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of one width; what is missing is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max()) if len(size) else 0
    if len(flat) == len(size) * width:
        out = flat.reshape(len(size), width).copy()
    else:
        out = np.full((len(size), width), np.nan)
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out[~np.isfinite(out)] = np.nan
    return out


class Moments:
    """Count, mean, sum of squared deviations, least and largest value of every dim."""

    def __init__(self):
        self.n = np.zeros(0, np.int64)
        self.mean, self.m2, self.low, self.high = (np.zeros(0) for _ in range(4))

    def _widen(self, width: int) -> None:
        more = width - len(self.n)
        if more > 0:
            self.n = np.pad(self.n, (0, more))
            self.mean, self.m2 = np.pad(self.mean, (0, more)), np.pad(self.m2, (0, more))
            self.low = np.pad(self.low, (0, more), constant_values=np.inf)
            self.high = np.pad(self.high, (0, more), constant_values=-np.inf)

    def add(self, x: np.ndarray, weight: np.ndarray | None = None, dims: np.ndarray | None = None) -> None:
        dims = np.arange(x.shape[1]) if dims is None else dims
        if not x.size or not len(dims):
            return
        self._widen(int(dims.max()) + 1)
        there = ~np.isnan(x)
        w = there.astype(np.int64) if weight is None else there * weight[:, None]
        n = w.sum(axis=0)
        some = n > 0
        value = np.where(there, x, 0.0)
        mean = np.divide((value * w).sum(axis=0), n, out=np.zeros(len(n)), where=some)
        m2 = (np.where(there, x - mean, 0.0) ** 2 * w).sum(axis=0)
        total = self.n[dims] + n
        gap = np.where(some, mean - self.mean[dims], 0.0)
        share = np.divide(n, total, out=np.zeros(len(n)), where=total > 0)
        self.m2[dims] += m2 + gap * gap * self.n[dims] * share
        self.mean[dims] += gap * share
        self.n[dims] = total
        used = there if weight is None else there & (weight[:, None] > 0)
        self.low[dims] = np.minimum(self.low[dims], np.where(used, x, np.inf).min(axis=0))
        self.high[dims] = np.maximum(self.high[dims], np.where(used, x, -np.inf).max(axis=0))

    def rows(self, key: str) -> dict[str, list]:
        at = np.flatnonzero(self.n)
        return {"key": [key] * len(at), "dim": at.tolist(), "n": self.n[at].tolist(), "mean": self.mean[at].tolist(),
                "m2": self.m2[at].tolist(), "min": self.low[at].tolist(), "max": self.high[at].tolist()}


def merged_moments(parts: DataFrame) -> DataFrame:
    """Partial moments (few rows per key and dim) to (key, dim, count, mean, std, min, max)."""
    every = Window.partitionBy("key", "dim")
    mean = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    p = parts.withColumn("_mean", mean)
    gap = F.col("mean") - F.col("_mean")
    return p.groupBy("key", "dim").agg(
        F.sum("n").alias("count"), F.first("_mean").alias("mean"),
        F.sqrt(F.sum(F.col("m2") + F.col("n") * gap * gap) / F.sum("n")).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"))


# ---------------------------------------------------------------- growing histograms
def bin_exponent(low: float, high: float, bins: int = NUM_BINS) -> int:
    """Least e for which bins of width 2^e cover [low, high] with at most ``bins`` bins and whole bin numbers."""
    lo, hi = EXPONENTS
    while lo < hi:
        e = (lo + hi) // 2
        w = np.ldexp(1.0, e)
        if np.floor(high / w) - np.floor(low / w) < bins and max(abs(low), abs(high)) < np.ldexp(w, FRACTION):
            hi = e
        else:
            lo = e + 1
    return lo


def bin_exponent_col(low: Column, high: Column, bins: int = NUM_BINS) -> Column:
    """``bin_exponent`` on columns (for few rows)."""
    def fits(e: Column) -> Column:
        w = F.pow(F.lit(2.0), e.cast("double"))
        return (F.floor(high / w).cast("double") - F.floor(low / w).cast("double") < bins) & (
            F.greatest(F.abs(low), F.abs(high)) < w * F.lit(float(1 << FRACTION)))

    near = F.floor(F.log2(F.greatest(high - low, F.greatest(F.abs(low), F.abs(high)) * F.lit(2.0 ** -40), F.lit(1e-80)))).cast("int")
    first, last = F.greatest(near - 56, F.lit(EXPONENTS[0])), F.least(near + 3, F.lit(EXPONENTS[1]))
    return F.get(F.filter(F.sequence(F.least(first, last), last), fits), 0)


class Growing:
    """Counts on the grid of bins of width 2^e; e rises as the range grows."""

    def __init__(self, bins: int):
        self.bins, self.e, self.base, self.counts = bins, None, 0, np.zeros(0, np.int64)

    def add(self, x: np.ndarray, low: float, high: float) -> None:
        """Count ``x``; [low, high] is the range of all values so far, these included."""
        e = bin_exponent(low, high, self.bins)
        old = self.base + np.arange(len(self.counts))
        if self.e is not None and e > self.e:
            old >>= e - self.e
        e = e if self.e is None else max(e, self.e)
        w = np.ldexp(1.0, e)
        base = int(np.floor(low / w))
        new = np.zeros(int(np.floor(high / w)) - base + 1, np.int64)
        np.add.at(new, old - base, self.counts)
        new += np.bincount(np.floor(x / w).astype(np.int64) - base, minlength=len(new))
        self.e, self.base, self.counts = e, base, new


def growing_parts(df: DataFrame, columns: Mapping[str, str], bins: int = NUM_BINS) -> DataFrame:
    """One row per task, key and dim: moments, the bins' exponent, and the bins in use (at most ``bins``)."""
    cols = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns.values())])
    keys = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = [Moments() for _ in keys]
        grown: dict[tuple[int, int], Growing] = {}
        for b in batches:
            for k, m in enumerate(moments):
                x = matrix(b.column(k))
                m.add(x)
                for d in range(x.shape[1]):
                    v = x[:, d][~np.isnan(x[:, d])]
                    if len(v):
                        grown.setdefault((k, d), Growing(bins)).add(v, m.low[d], m.high[d])
        for k, m in enumerate(moments):
            rows = m.rows(keys[k])
            hist = [grown[(k, d)] for d in rows["dim"]]
            used = [np.flatnonzero(h.counts) for h in hist]
            rows |= {"e": [h.e for h in hist], "bin": [(h.base + u).tolist() for h, u in zip(hist, used)], "c": [h.counts[u].tolist() for h, u in zip(hist, used)]}
            yield pa.RecordBatch.from_pydict(rows, schema=_PART)

    return cols.mapInArrow(run, _MOMENTS + ", e int, bin array<long>, c array<long>")


_PART = pa.schema([("key", pa.string()), ("dim", pa.int64()), ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()),
                   ("min", pa.float64()), ("max", pa.float64()), ("e", pa.int32()), ("bin", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])


def merged_growing(parts: DataFrame, quantiles: Sequence[float] = QUANTILES, bins: int = NUM_BINS) -> DataFrame:
    """Partial rows of any number of tasks and batches to (key, dim, count, mean, std, min, max, q01, q99).

    A quantile is the left edge of the first bin at which the running count reaches
    q * n, at least the minimum: at most a bin's width (range / 2500 or less) off.
    """
    m = merged_moments(parts.drop("bin", "c")).withColumn("_e", bin_exponent_col(F.col("min"), F.col("max"), bins))
    b = parts.select(F.col("key").alias("_key"), F.col("dim").alias("_dim"), F.col("e").alias("_from"), F.explode(F.arrays_zip("bin", "c")).alias("h"))
    b = b.join(m, (F.col("_key") == F.col("key")) & (F.col("_dim") == F.col("dim")))
    coarse = F.expr("shiftright(h.bin, greatest(0, _e - _from))")
    group = ["key", "dim", "count", "mean", "std", "min", "max", "_e"]
    hist = b.groupBy(*group, coarse.alias("bin")).agg(F.sum("h.c").alias("c"))
    upto = Window.partitionBy("key", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("c").over(upto))
    firsts = [F.min(F.when(F.col("_upto") >= F.lit(q) * F.col("count"), F.col("bin"))).alias(_qname(q)) for q in quantiles]
    out = hist.groupBy(*group).agg(*firsts)
    width = F.pow(F.lit(2.0), F.col("_e").cast("double"))
    return out.select("key", "dim", "count", "mean", "std", "min", "max",
                      *[F.greatest(F.col("min"), F.col(_qname(q)) * width).alias(_qname(q)) for q in quantiles])


def growing_stats(df: DataFrame, columns: Mapping[str, str], quantiles: Sequence[float] = QUANTILES, bins: int = NUM_BINS) -> DataFrame:
    """A1–A3 in one pass over the vector columns ``columns`` (key → column)."""
    return merged_growing(growing_parts(df, columns, bins), quantiles, bins)


# ---------------------------------------------------------------- A4 on frames
class _Chunks:
    """States and chunk rows of whole segments of frames, batch after batch."""

    def __init__(self, horizon: int, mask: Sequence[bool]):
        self.horizon, self.mask, self.held = horizon, np.array(mask, dtype=bool), None

    def of(self, batches: Iterator[pa.RecordBatch]):
        """(states, weighted rows, their weights, their dims, [delta rows], their dims) of runs of segments."""
        for b in batches:
            new = (b.column("_g").to_numpy(), b.column("_t").to_numpy(), b.column("_own").to_numpy(zero_copy_only=False),
                   matrix(b.column("_s")), matrix(b.column("_a")))
            rows = new if self.held is None else tuple(_stack(x, y) for x, y in zip(self.held, new))
            group, t = rows[0], rows[1]
            edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (t[1:] != t[:-1] + 1)])) if len(t) else [0]
            cut = int(edge[-1])  # the last segment may go on in the next batch
            self.held = tuple(x[cut:] for x in rows)
            if cut:
                yield self._made([x[:cut] for x in rows], np.append(edge[:-1], cut))
        if self.held is not None and len(self.held[0]):
            rows = self.held
            edge = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1] + 1)]))
            yield self._made(list(rows), np.append(edge, len(rows[0])))

    def _made(self, rows: list, edge: np.ndarray):
        _, _, own, state, actions = rows
        last = np.repeat(edge[1:] - 1, np.diff(edge))[own]
        at = np.flatnonzero(own)
        width = min(actions.shape[1], len(self.mask))
        delta = np.flatnonzero(self.mask[:width])
        rest = np.setdiff1d(np.arange(actions.shape[1]), delta)
        steps = [np.minimum(at + i, last) for i in range(self.horizon)]
        weight = np.zeros(len(own), np.int64)
        for s in steps:
            weight += np.bincount(s, minlength=len(own))
        base = np.full((len(at), len(delta)), np.nan)
        here = delta < state.shape[1]
        base[:, here] = state[at][:, delta[here]]
        shifted = (actions[s][:, delta] - base for s in steps) if len(delta) else ()
        return state[at], actions[:, rest], weight, rest, shifted, delta


def _stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.ndim == 2 and a.shape[1] != b.shape[1]:
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan) for x in (a, b))
    return np.concatenate([a, b])


def _dealt(frames: DataFrame, horizon: int, state: str, actions: str, keys: Sequence[str], t: str) -> DataFrame:
    """Frames in segments (with the next segment's first rows), in order inside each task."""
    rows, _, _ = frame_window(frames.select(*keys, t, state, actions), list(keys), t, after=horizon - 1)
    rows = rows.repartition(*[F.col(k) for k in keys], F.col("_seg")).sortWithinPartitions(*keys, "_seg", t)
    return rows.select(F.xxhash64(*keys, "_seg").alias("_g"), F.col(t).cast("long").alias("_t"), "_own",
                       F.col(state).cast("array<double>").alias("_s"), F.col(actions).cast("array<double>").alias("_a"))


def chunk_stats(frames: DataFrame, horizon: int, delta_mask: Sequence[bool] | None, state: str = "state", actions: str = "actions",
                keys: Sequence[str] = ("episode_id",), t: str = "t", quantiles: Sequence[float] = QUANTILES,
                bins: int = NUM_BINS, min_count: int = 2) -> DataFrame:
    """A4: (key, dim, count, mean, std, min, max, q01, q99) of states and of all rows of delta action chunks.

    Two passes over the frames. The first job gives the ranges, one row per key and dim,
    which the tasks of the second pass get with their code; it counts the 5000 bins over
    them. Fewer than ``min_count`` vectors is an error.
    """
    dealt, mask = _dealt(frames, horizon, state, actions, keys, t), list(delta_mask or ())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, a = Moments(), Moments()
        for own, flat, weight, rest, shifted, delta in _Chunks(horizon, mask).of(batches):
            s.add(own)
            a.add(flat, weight, rest)
            for x in shifted:
                a.add(x, None, delta)
        for key, m in ((state, s), (actions, a)):
            yield pa.RecordBatch.from_pydict(m.rows(key), schema=pa.schema(list(_PART)[:7]))

    found = merged_moments(dealt.mapInArrow(first, _MOMENTS)).collect()  # a row a key and dim
    if any(r["count"] < min_count for r in found):
        raise ValueError(f"Cannot compute statistics for less than {min_count} vectors.")
    low = {(r["key"], r["dim"]): r["min"] - RANGE_PAD for r in found}
    high = {(r["key"], r["dim"]): r["max"] + RANGE_PAD for r in found}

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros(bins, np.int64) for k in low}

        def add(key: str, x: np.ndarray, dims: np.ndarray, weight: np.ndarray | None = None) -> None:
            for j, d in enumerate(dims.tolist()):
                there = ~np.isnan(x[:, j])
                if (key, d) in low and there.any():
                    lo, hi = low[(key, d)], high[(key, d)]
                    at = np.minimum(bins - 1, np.floor((x[there, j] - lo) * (float(bins) / (hi - lo)))).astype(np.int64)
                    if weight is None:
                        counts[(key, d)] += np.bincount(at, minlength=bins)
                    else:
                        counts[(key, d)] += np.bincount(at, weights=weight[there], minlength=bins).astype(np.int64)

        for own, flat, weight, rest, shifted, delta in _Chunks(horizon, mask).of(batches):
            add(state, own, np.arange(own.shape[1]))
            add(actions, flat, rest, weight)
            for x in shifted:
                add(actions, x, delta)
        for (key, d), c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(used), pa.string()), "dim": pa.array([d] * len(used), pa.int64()),
                                              "bin": pa.array(used, pa.int64()), "c": pa.array(c[used], pa.int64())})

    hist = dealt.mapInArrow(second, "key string, dim long, bin long, c long").groupBy("key", "dim", "bin").agg(F.sum("c").alias("c"))
    hist = hist.withColumn("_upto", F.sum("c").over(Window.partitionBy("key", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    ranges = frames.sparkSession.createDataFrame([tuple(r) for r in found], "key string, dim long, count long, mean double, std double, min double, max double")
    h = hist.join(F.broadcast(ranges), ["key", "dim"])  # a row a key and dim
    group = ["key", "dim", "count", "mean", "std", "min", "max"]
    out = h.groupBy(*group).agg(*[F.min(F.when(F.col("_upto") >= F.lit(q) * F.col("count"), F.col("bin"))).alias(_qname(q)) for q in quantiles])
    lo, hi = F.col("min") - F.lit(RANGE_PAD), F.col("max") + F.lit(RANGE_PAD)
    return out.select(*group, *[(F.col(_qname(q)) * ((hi - lo) / F.lit(float(bins))) + lo).alias(_qname(q)) for q in quantiles])
