"""Column expressions on float vectors (``ARRAY<DOUBLE>``) and chunks (``ARRAY<ARRAY<DOUBLE>>``).

All of these are JVM-side higher-order functions; nothing leaves the JVM.
Stats arguments are array columns (from a joined stats row) or Python lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, (list, tuple)):
        return F.array(*[F.lit(float(v)) for v in x])
    return F.lit(x)


def field(name: str):
    """Lambda for ``transform`` picking one struct field (no default-arg lambdas:
    PySpark counts their parameters)."""
    return lambda s: s[name]


def once(fn, *cols) -> Column:
    """``fn(*cols)`` with every column computed once a row, however often ``fn`` reads it.

    The optimiser copies a column's expression to each place that reads it: into lambdas, where
    it is computed again for every element, and into filters pushed below a chain of steps,
    which grow with each step. Here the columns are fields of one lambda variable.
    """
    row = F.struct(*[_c(c).alias(f"c{n}") for n, c in enumerate(cols)])
    return F.get(F.transform(F.array(row), lambda r: fn(*[r[f"c{n}"] for n in range(len(cols))])), 0)


def listed(x) -> Column:
    """``x``, empty where null: explode this, as a plain column adds a filter on its size that computes it twice."""
    return F.coalesce(_c(x), F.array())


def _at(arr: Column, i: Column) -> Column:
    """0-based element, null when out of range."""
    return F.get(arr, i)


def _long_enough(x: Column, stats: dict[str, Column], new: Column) -> Column:
    """``new``, or an error if one of the stats is missing or shorter than ``x``."""
    short = F.lit(False)
    for arr in stats.values():
        short = short | arr.isNull() | (F.size(arr) < F.size(x))
    error = F.raise_error(F.lit(f"{' or '.join(stats)} missing or shorter than the vector"))
    return F.when(x.isNotNull() & short, error.cast("array<double>")).otherwise(new)


def normalize_z(x, mean, std) -> Column:
    """M1 ``(x - mean) / (std + 1e-6)``; stats cut to len(x), shorter ones are an error."""
    return once(lambda xc, m, s: _long_enough(xc, {"mean": m, "std": s}, F.transform(
        xc, lambda v, i: (v - _at(m, i)) / (_at(s, i) + F.lit(EPS)))), x, mean, std)


def normalize_q(x, q01, q99) -> Column:
    """M2 ``(x - q01) / (q99 - q01 + 1e-6) * 2 - 1``; stats cut to len(x), shorter ones are an error."""
    return once(lambda xc, lo, hi: _long_enough(xc, {"q01": lo, "q99": hi}, F.transform(
        xc, lambda v, i: (v - _at(lo, i)) / (_at(hi, i) - _at(lo, i) + F.lit(EPS)) * F.lit(2.0) - F.lit(1.0))), x, q01, q99)


def unnormalize_z(x, mean, std) -> Column:
    """M3 ``x * (std + 1e-6) + mean``; stats padded with mean 0, std 1 beyond their length."""
    return once(lambda xc, m, s: F.transform(xc, lambda v, i: v * (F.coalesce(_at(s, i), F.lit(1.0)) + F.lit(EPS))
                                             + F.coalesce(_at(m, i), F.lit(0.0))), x, mean, std)


def unnormalize_q(x, q01, q99) -> Column:
    """M4 ``(x + 1) / 2 * (q99 - q01 + 1e-6) + q01``; dims beyond the stats pass through."""
    return once(lambda xc, lo, hi: F.transform(xc, lambda v, i: F.when(
        i < F.size(lo), (v + F.lit(1.0)) / F.lit(2.0) * (_at(hi, i) - _at(lo, i) + F.lit(EPS)) + _at(lo, i)
    ).otherwise(v)), x, q01, q99)


def on_rows(chunk, fn) -> Column:
    """Apply a vector function to every row of a chunk (``ARRAY<ARRAY<…>>``)."""
    return F.transform(_c(chunk), fn)


def shift_actions(actions, state, mask: Sequence[bool] | None, sign: float) -> Column | None:
    """M5 core: on the first len(mask) dims add ``sign * state`` where mask is true, for every chunk row."""
    if mask is None:
        return None
    m = F.array(*[F.lit(bool(b)) for b in mask])
    dims = len(mask)
    return once(lambda rows, st: F.transform(rows, lambda row: F.transform(row, lambda v, i: F.when(
        (i < F.lit(dims)) & F.coalesce(_at(m, i), F.lit(False)), v + F.lit(sign) * _at(st, i)
    ).otherwise(v))), actions, state)


def delta_actions(actions, state, mask) -> Column:
    """M5 delta: ``actions[..., :d] -= where(mask, state[:d], 0)``; null mask = no-op."""
    out = shift_actions(actions, state, mask, -1.0)
    return _c(actions) if out is None else out


def absolute_actions(actions, state, mask) -> Column:
    """M5 absolute: inverse of ``delta_actions``."""
    out = shift_actions(actions, state, mask, 1.0)
    return _c(actions) if out is None else out


def make_bool_mask(*dims: int) -> list[bool]:
    """M11 signed run lengths → mask: ``(2,-2,2)`` → TTFFTT, 0 adds nothing."""
    out: list[bool] = []
    for d in dims:
        out.extend([d > 0] * abs(d))
    return out


def pad_to_dim(x, dim: int, value: float = 0.0) -> Column:
    """M10 right-pad to ``dim`` with ``value``; longer vectors unchanged."""
    return once(lambda xc: F.concat(xc, F.array_repeat(F.lit(float(value)), F.greatest(F.lit(dim) - F.size(xc), F.lit(0)))), x)


def first_k(x, k: int) -> Column:
    """M12 ``x[..., :k]`` of a vector."""
    return F.slice(_c(x), 1, k)


def chunk_first_k(chunk, k: int) -> Column:
    return F.transform(_c(chunk), lambda row: F.slice(row, 1, k))


def chunk_stride(chunk, stride: int) -> Column:
    """P11 every ``stride``-th row of a chunk, from row 0."""
    return F.filter(_c(chunk), lambda _, i: i % F.lit(stride) == 0)


def discretize(x, bins: int = 256) -> Column:
    """M13 ``digitize(x, linspace(-1, 1, bins+1)[:-1]) - 1``: -1 below, bins-1 at/above top, NaN → bins-1."""
    half = bins / 2.0
    return F.transform(_c(x), lambda v: F.when(F.isnan(v), F.lit(bins - 1)).otherwise(
        F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(bins - 1.0), (v + F.lit(1.0)) * F.lit(half)))).cast("int")))


def bin_decode(tokens, horizon: int, dim: int, n_bins: int = 256) -> Column:
    """M20 first ``horizon*dim`` tokens → ``[horizon, dim]`` of ``t / n_bins * 2 - 1``; too few → zeros."""
    tk = _c(tokens)
    need = horizon * dim
    rows = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda r: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda c: F.get(tk, r * F.lit(dim) + c).cast("double") / F.lit(float(n_bins)) * F.lit(2.0) - F.lit(1.0)))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), dim), horizon)
    return F.when(F.size(tk) < F.lit(need), zeros).otherwise(rows)


def token_remap(tokens, vocab_size: int) -> Column:
    """M18 ``vocab - 1 - 128 - t`` (its own inverse)."""
    return F.transform(_c(tokens), lambda t: F.lit(vocab_size - 1 - 128) - t)


def clip_binarize_last(x) -> Column:
    """P25 last dim ``> 0.5 → 1 else 0``, then every dim clipped to [-1, 1]."""
    xc = _c(x)
    n = F.size(xc)
    return F.transform(xc, lambda v, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(
        i == n - 1, F.when(v > F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(v))))


def byte_to_unit(x) -> Column:
    """M25 ``x / 255 * 2 - 1``."""
    return F.transform(_c(x), lambda v: v.cast("double") / F.lit(255.0) * F.lit(2.0) - F.lit(1.0))


def unit_to_byte(x) -> Column:
    """M25 float in [0,1] → ``trunc(255 * x)`` as int."""
    return F.transform(_c(x), lambda v: (v * F.lit(255.0)).cast("int"))


def quat_to_axis_angle(x, y, z, w) -> Column:
    """M21 quaternion (x, y, z, w) → axis-angle 3-vector.

    w is clipped to [-1, 1]; when ``sqrt(1 - w²)`` is exactly 0 the rotation is
    zero; otherwise ``xyz * 2 * acos(w) / sqrt(1 - w²)``.
    """
    wc = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(w)))
    den = F.sqrt(F.lit(1.0) - wc * wc)

    def comp(v):
        return F.when(den == F.lit(0.0), F.lit(0.0)).otherwise(_c(v) * F.lit(2.0) * F.acos(wc) / den)

    return F.array(comp(x), comp(y), comp(z))


def l1_l2(pred, target) -> tuple[Column, Column]:
    """A5 per-sample mean |d| and sqrt(mean d²) of two equal-length vectors."""
    d = F.zip_with(_c(pred), _c(target), lambda a, b: a - b)
    n = F.size(d).cast("double")
    l1 = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / n
    l2 = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v * v) / n)
    return l1, l2
