"""Exact quantiles by radix selection: histogram rounds, no sort and no shuffle of the values.

A double becomes a 64-bit whole number of the same order. Round one counts the
values by its top bits, and a running sum over the counts tells which bin holds
each wanted rank; the next round counts only the values of those bins by their
next bits, until all bits are fixed. Counts are aggregated map-side, so a group
that holds a third of all rows costs what others do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.plans.ordered import join_null_safe

#: Bits below the prefix that each round fixes: 22, 21 and 21 of the 64.
LEVELS = (42, 21, 0)

# Fixed values of IEEE doubles: bits of the fraction, least and largest exponent.
FRACTION_BITS = 52
LEAST_EXPONENT = -1022
LARGEST_EXPONENT = 1023


def ordered_bits(x: Column) -> Column:
    """64-bit whole number that orders as the double ``x`` does; NaN is the largest, both zeros are 0, null stays null.

    For values from zero on these are the double's own bits; below zero, their negative.
    """
    size, unit = F.abs(x), float(1 << FRACTION_BITS)
    guess = F.coalesce(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT))  # one off at most
    guess = F.greatest(F.lit(LEAST_EXPONENT), F.least(F.lit(LARGEST_EXPONENT), guess))
    power = F.pow(F.lit(2.0), guess)
    below = ((power > size) & (guess > LEAST_EXPONENT)).cast("bigint")
    above = ((size / power >= 2.0) & (guess < LARGEST_EXPONENT)).cast("bigint")
    exponent = guess - below + above
    fraction = (size / F.pow(F.lit(2.0), exponent) * F.lit(unit)).cast("bigint")
    bits = (exponent - LEAST_EXPONENT) * F.lit(1 << FRACTION_BITS) + fraction
    infinite = F.lit((LARGEST_EXPONENT - LEAST_EXPONENT + 2) << FRACTION_BITS)
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    return (F.when(x.isNull(), F.lit(None).cast("bigint")).when(F.isnan(x), infinite + 1)
            .when(size == float("inf"), sign * infinite).otherwise(sign * bits))


def _holding(bins: DataFrame, found: DataFrame | None, keys: list[str], ranks: Column) -> DataFrame:
    """The bins that hold a wanted rank, one row each, with a list of (quantile, weight, rank inside the bin)."""
    within = keys if found is None else [*keys, "_in"]
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    upto = F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("_before", upto - F.col("_c"))
    if found is None:
        bins = bins.withColumn("_n", F.sum("_c").over(w)).withColumn("_want", ranks)
    else:
        bins = join_null_safe(bins, found.select(*keys, F.col("_bin").alias("_in"), "_want"), within)
    here = F.filter("_want", lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_c")))
    inside = F.transform(here, lambda r: F.struct(r["q"].alias("q"), r["weight"].alias("weight"),
                                                  (r["rank"] - F.col("_before")).alias("rank")))
    return bins.withColumn("_want", inside).filter(F.size("_want") > 0).drop("_in", "_n", "_before", "_c")


def select_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float],
                     prefix: str = "p", few_groups: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per group (numpy's default), one column ``<prefix><100 q>`` each.

    A null key is a group like others; null values do not count, a group of nulls has no
    row. NaN counts as the largest value. ``few_groups``: the groups are bounded by
    construction (a literal list), so the bins of the wanted ranks, at most two a group
    and quantile, are broadcast; otherwise AQE decides by their measured size.

    ``df`` is read once a round: write out or checkpoint what is dear to make.
    """
    k = list(keys)
    x = F.col(f"`{value}`").cast("double")
    base = df.select(*[F.col(f"`{c}`") for c in k], x.alias("_x")).filter(F.col("_x").isNotNull())
    base = base.withColumn("_f", ordered_bits(F.col("_x")))

    entries = []
    for q in quantiles:
        pos = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        low, high = F.floor(pos), F.ceil(pos)
        for rank, weight in ((low, F.lit(1.0) - (pos - low)), (high, pos - low)):
            entries.append(F.struct(F.lit(float(q)).alias("q"), weight.alias("weight"), rank.alias("rank")))
    ranks = F.filter(F.array(*entries), lambda e: e["weight"] > 0)

    found = None
    for n, shift in enumerate(LEVELS):
        rows = base.withColumn("_bin", F.shiftright("_f", shift))
        if found is not None:
            rows = rows.withColumn("_in", F.shiftright("_f", LEVELS[n - 1]))
            held = found.select(*k, F.col("_bin").alias("_in"))
            rows = join_null_safe(rows, F.broadcast(held) if few_groups else held, [*k, "_in"], "left_semi")
        # in the last round all values of a bin are equal
        value_of = [F.max("_x").alias("_v")] if shift == 0 else []
        bins = rows.groupBy(*k, *(["_in"] if found is not None else []), "_bin").agg(F.count(F.lit(1)).alias("_c"), *value_of)
        found = _holding(bins, found, k, ranks)
    parts = found.select(*k, "_v", F.explode("_want").alias("_w"))
    sums = parts.groupBy(*k, F.col("_w.q").alias("q")).agg(F.sum(F.col("_v") * F.col("_w.weight")).alias("_s"))
    out = sums.groupBy(*k).pivot("q", [float(q) for q in quantiles]).agg(F.first("_s"))
    return out.select(*[F.col(f"`{c}`") for c in k],
                      *[F.col(f"`{float(q)}`").alias(f"{prefix}{round(q * 100)}") for q in quantiles])
