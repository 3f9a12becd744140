"""Order-dependent building blocks that stay parallel when one episode is huge.

A per-episode ``Window.partitionBy(episode)`` puts a whole episode in one
task. Episodes can be very unequal (one may hold a third of all frames), so
the helpers here never need a whole episode in one place. There is one plan
for all sizes, decided by the order column's type alone (no sample, no count,
no threshold):

* rows are cut into blocks by a coarse, order-preserving value of the first
  order column (``order_block``), windows run per (group, block), and what lies
  in earlier blocks comes from prefix sums over the small table of blocks,
  which is itself cut into ranges of blocks;
* ``index_within`` – dense 0-based position inside a group;
* ``running_agg`` / ``running_sum`` – prefix sum, maximum or minimum;
* ``frame_window`` / ``neighbours`` – rows ``t-before .. t+after`` of the same
  episode, via fixed-size segments of the frame index plus a small halo
  copied from the adjacent segment (window per (episode, segment)).

Group keys may be null: all joins on them are null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frames in a segment of ``frame_window``.
SEGMENT = 4096
#: Whole numbers per block, as bits; blocks per range of blocks, as bits.
BLOCK_BITS = 12
RANGE_BITS = 18
#: Blocks from a fraction to its double; bytes of a text that say its block.
FRACTION_STEPS = 4096
TEXT_BYTES = 6
#: Blocks of a uniformly hashed 64-bit order, as bits.
HASH_BITS = 18


def order_block(df: DataFrame, col: str, hashed: bool = False) -> Column:
    """Block number of ``col``: never decreases as the value grows; nulls come first.

    Whole numbers: 4096 to a block. Timestamps: about 67 seconds. Dates: 16
    days. Fractions: steps of 2^(1/4096) of the absolute value, so that any range of
    values spreads over many blocks. Texts: six bytes after what all of them share.
    ``hashed``: the top 18 bits of a 64-bit hash.
    """
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, T.BooleanType):
        block = c.cast("bigint")
    elif isinstance(kind, T.IntegralType):
        block = F.shiftright(c.cast("bigint"), 64 - HASH_BITS if hashed else BLOCK_BITS)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        block = F.shiftright(F.unix_micros(c.cast("timestamp")), 26)
    elif isinstance(kind, T.DateType):
        block = F.shiftright(F.unix_date(c).cast("bigint"), 4)
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        x = c.cast("double")
        size = F.floor((F.least(F.log2(F.abs(x)), F.lit(1025.0)) + 1076.0) * FRACTION_STEPS)
        block = F.when(F.isnan(x), F.lit(1 << 24)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("bigint")
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        b = F.col("_b")
        ends = df.select(c.cast("binary").alias("_b")).agg(F.min(b).alias("lo"), F.max(b).alias("hi"))
        shorter = F.least(F.octet_length("lo"), F.octet_length("hi"))
        same = F.filter(F.sequence(F.lit(0), shorter), lambda i: F.substring("lo", 1, i) == F.substring("hi", 1, i))
        skip = F.coalesce(ends.select(F.array_max(same)).scalar(), F.lit(0))
        head = F.rpad(F.hex(F.substr(c.cast("binary"), skip + 1, F.lit(TEXT_BYTES))), 2 * TEXT_BYTES, "0")
        block = F.conv(head, 16, 10).cast("bigint")
    else:
        block = F.lit(0).cast("bigint")
    return F.coalesce(block, F.lit(-(1 << 62)))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns in which null matches null; the left's columns stay."""
    names = {c: f"_r_{c}" for c in on}
    r = right.select(*[F.col(f"`{c}`").alias(names[c]) if c in names else F.col(f"`{c}`") for c in right.columns])
    cond = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()]
    out = left.join(r, cond, how)
    return out.drop(*names.values())


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(a: Column, b: Column, agg: str) -> Column:
    if agg == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    both = F.greatest if agg == "max" else F.least
    return both(a, b)  # skips nulls


def _ranges_before(ranges: DataFrame, keys: list[str], agg: str) -> DataFrame:
    """Per (key, range of blocks): the aggregate of all earlier ranges (few rows per key)."""
    if keys:
        w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return ranges.withColumn("_far", _AGG[agg]("_all").over(w)).drop("_all")
    # no key: one row per range of 2^18 blocks, added up in one window
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_far", _AGG[agg]("_all").over(w)).drop("_all")


def _block_offsets(d: DataFrame, keys: list[str], value: Column, agg: str) -> DataFrame:
    """Per (key, block): ``agg`` of ``value`` over all earlier blocks of the key, as ``_off``; keys are never null."""
    blocks = d.groupBy(*keys, "_range", "_block").agg(_AGG[agg](value).alias("_all"))
    w = Window.partitionBy(*keys, "_range").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.withColumn("_near", _AGG[agg]("_all").over(w)).drop("_all")
    ranges = blocks.groupBy(*keys, "_range").agg(_AGG[agg]("_all").alias("_all"))
    out = near.join(_ranges_before(ranges, keys, agg), [*keys, "_range"])
    return out.withColumn("_off", _merge(F.col("_near"), F.col("_far"), agg)).select(*keys, "_block", "_off")


def _whole_keys(df: DataFrame, keys: list[str]) -> dict[str, Column]:
    """Columns that are never null and tell groups apart as ``keys`` do, null keys among them.

    Windows and plain equi-joins on them need one shuffle; a null-safe join on the keys
    themselves would deal all rows out a second time.
    """
    out = {}
    for key in keys:
        c = F.col(f"`{key}`")
        if isinstance(df.schema[key].dataType, T.IntegralType):
            out |= {f"{key}__whole": F.coalesce(c, F.lit(0).cast(df.schema[key].dataType)), f"{key}__null": c.isNull()}
        else:
            out[f"{key}__whole"] = F.struct(c)
    return out


def _cut(df: DataFrame, keys: list[str], order: list[str], hashed: bool) -> tuple[DataFrame, list[str]]:
    """Rows with their block and range of blocks, and the names of their never-null keys."""
    whole = _whole_keys(df, keys)
    d = df.withColumns({**whole, "_block": order_block(df, order[0], hashed)})
    return d.withColumn("_range", F.shiftright("_block", RANGE_BITS)), list(whole)


def index_within(df: DataFrame, keys: list[str], order: list[str], out: str = "t", hashed: bool = False) -> DataFrame:
    """Add ``out`` = 0-based row number inside ``keys`` by ``order`` (nulls first).

    Equal to ``row_number() over (partition by keys order by order) - 1`` when
    ``order`` is a total order. ``hashed``: the first order column is a uniform
    64-bit hash.
    """
    d, whole = _cut(df, keys, order, hashed)
    w = Window.partitionBy(*whole, "_block").orderBy(*order)
    local = d.withColumn("_r", F.row_number().over(w) - 1).drop("_range")
    joined = local.join(_block_offsets(d, whole, F.lit(1), "sum"), [*whole, "_block"])
    made = joined.withColumn(out, (F.col("_r") + F.col("_off")).cast("bigint"))
    return made.select(*[f"`{c}`" for c in dict.fromkeys([*df.columns, out])])


def running_agg(df: DataFrame, value, order: list[str], out: str, keys: list[str] | None = None,
                agg: str = "sum", include_current: bool = True, hashed: bool = False) -> DataFrame:
    """Add ``out`` = running ``agg`` (sum/max/min) of ``value`` in ``order`` inside ``keys``.

    A running window per (key, block), combined with the aggregate of all
    earlier blocks of the key. With ``include_current=False`` the current row is
    left out (null when nothing precedes it, 0 for sums).
    """
    keys = keys or []
    val = F.col(value) if isinstance(value, str) else value
    d, whole = _cut(df.withColumn("_v", val), keys, order, hashed)
    upto = 0 if include_current else -1
    w = Window.partitionBy(*whole, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = d.withColumn("_r", _AGG[agg]("_v").over(w)).drop("_range")
    joined = local.join(_block_offsets(d, whole, F.col("_v"), agg), [*whole, "_block"])
    made = joined.withColumn(out, _merge(F.col("_r"), F.col("_off"), agg))
    return made.select(*[f"`{c}`" for c in dict.fromkeys([*df.columns, out])])


def running_sum(df: DataFrame, value: str, order: list[str], out: str, keys: list[str] | None = None) -> DataFrame:
    """Inclusive running sum (see ``running_agg``)."""
    return running_agg(df, value, order, out, keys, "sum", True)


def frame_window(df: DataFrame, keys: list[str], t: str, before: int = 0, after: int = 0,
                 segment: int | None = None):
    """Rows plus a window spec that sees ``t-before .. t+after`` of the same group.

    Returns ``(rows, window, finish)``: compute window expressions on
    ``rows`` over ``window``, then call ``finish`` on the result. Rows are cut
    into fixed-size segments of ``t``; rows within reach of a segment border
    are emitted once more (one ``explode``, input plan not duplicated) as halo
    copies for the neighbouring segment, and ``finish`` drops those copies.
    ``t`` must be the dense 0-based index inside ``keys``.
    """
    segment = segment or SEGMENT
    if max(before, after) >= segment:
        raise ValueError("segment must exceed the window reach")
    tc = F.col(t)
    seg = F.floor(tc / F.lit(segment))
    pos = tc % F.lit(segment)
    copies = [F.struct(seg.alias("s"), F.lit(True).alias("own"))]
    if after:
        copies.append(F.when((tc >= segment) & (pos < after), F.struct((seg - 1).alias("s"), F.lit(False).alias("own"))))
    if before:
        copies.append(F.when(pos >= segment - before, F.struct((seg + 1).alias("s"), F.lit(False).alias("own"))))
    arr = F.filter(F.array(*copies), lambda c: c.isNotNull()) if len(copies) > 1 else F.array(*copies)
    u = df.withColumn("_c", F.explode(arr)).withColumn("_seg", F.col("_c.s")).withColumn("_own", F.col("_c.own")).drop("_c")
    w = Window.partitionBy(*keys, "_seg").orderBy(t)
    return u, w, (lambda x: x.filter("_own").drop("_seg", "_own"))


def neighbours(df: DataFrame, keys: list[str], t: str, cols: list[str], before: int = 0,
               after: int = 0, out: str = "_win", segment: int | None = None) -> DataFrame:
    """Add ``out`` = ``collect_list(struct(cols))`` over rows ``[t-before, t+after]`` of the group."""
    rows, w, finish = frame_window(df, keys, t, before, after, segment)
    return finish(rows.withColumn(out, F.collect_list(F.struct(*cols)).over(w.rowsBetween(-before, after))))
