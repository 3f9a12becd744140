"""Sampling, mixing, batching.

Global positions come from ``index_within`` (block-cut numbering, no single
task); random choices come from ``functions.hashing`` (partition-independent).
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.functions.hashing import hash_key, unit_hash
from epiframe.plans.ordered import index_within
from epiframe.session import join_small

WEIGHT_TOLERANCE = 1e-9


def shuffle_order(df: DataFrame, keys: Sequence[str], seed: int = 0, epoch: int = 0, out: str = "pos") -> DataFrame:
    """A true global shuffle as a position ``pos`` = rank of ``hash(keys, seed, epoch)``."""
    h = df.withColumn("_h", hash_key(*keys, F.lit(epoch), seed=seed))
    return index_within(h, [], ["_h", *keys], out=out, hashed=True).drop("_h")


# Fixed values of the round function: two odd multipliers below 2^31.
_MULTIPLY = (1_103_515_245, 1_597_334_677)
_ROUNDS = 4


def _spread(x: Column, key: Column) -> Column:
    """31 well-mixed bits of a whole number below 2^31 and a round's key."""
    low = (1 << 31) - 1
    h = x * F.lit(_MULTIPLY[0]) + key
    h = h.bitwiseXOR(F.shiftright(h, 17)).bitwiseAND(F.lit(low)) * F.lit(_MULTIPLY[1])
    return h.bitwiseXOR(F.shiftright(h, 15)).bitwiseAND(F.lit(low))


def round_keys(seed: int, epoch: int) -> list[int]:
    """Keys of the rounds, below 2^31."""
    return [int(hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest()[:7], 16) for i in range(_ROUNDS)]


def permuted(index: Column, n: Column, seed: int = 0, epoch: int = 0) -> Column:
    """A keyed permutation of 0 .. n - 1 (n up to 2^60) as an expression of the index alone: no sort, no exchange.

    The index is written as two digits (base ceil(sqrt(n))); each round adds a hash of one
    digit to the other and swaps them, which can be undone, so the rounds permute the square.
    Where they lead to n or beyond (a digit's worth of places at most), they run again.
    """
    keys = F.array(*[F.lit(k).cast("bigint") for k in round_keys(seed, epoch)])

    def rounds(x: Column, a: Column) -> Column:
        digits = F.struct((x % a).alias("l"), F.floor(x / a).cast("bigint").alias("r"), a.alias("a"))
        done = F.aggregate(keys, digits, lambda s, key: F.struct(
            s["r"].alias("l"), ((s["l"] + _spread(s["r"], key)) % s["a"]).alias("r"), s["a"].alias("a")))
        return done["r"] * a + done["l"]

    size = F.greatest(n, F.lit(1)).cast("bigint")
    start = F.struct(index.cast("bigint").alias("x"), size.alias("n"), F.ceil(F.sqrt(size.cast("double"))).cast("bigint").alias("a"))

    def again(p: Column) -> Column:
        """Few come here: on until below n."""
        step = F.aggregate(F.sequence(F.lit(1), F.lit(64)), p, lambda s, _: F.when(s["x"] < s["n"], s).otherwise(
            F.struct(rounds(s["x"], s["a"]).alias("x"), s["n"].alias("n"), s["a"].alias("a"))))
        return F.when(step["x"] < step["n"], step["x"]).otherwise(F.raise_error(F.lit("no place found")).cast("bigint"))

    # a transform of one element names the first result
    first = F.transform(F.array(start), lambda s: F.struct(rounds(s["x"], s["a"]).alias("x"), s["n"].alias("n"), s["a"].alias("a")))
    return F.get(F.transform(first, lambda p: F.when(p["x"] < p["n"], p["x"]).otherwise(again(p))), 0)


def shuffle_dense(df: DataFrame, index: str, n: int | DataFrame, seed: int = 0, epoch: int = 0, buffer: int | None = None,
                  out: str = "pos") -> DataFrame:
    """T2 on a dense 0-based ``index``: ``out`` = its place in the shuffled order.

    ``n``: the number of rows, or a DataFrame to count in the plan. ``buffer``: rows move
    inside runs of so many rows only, as a shuffle buffer does, every run by a key of its
    own. Another ``epoch`` is another order.
    """
    rows = F.lit(n) if isinstance(n, int) else n.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = df.withColumn("_n", rows)
    if buffer is None:
        return df.withColumn(out, permuted(F.col(index), F.col("_n"), seed, epoch)).drop("_n")
    run = F.floor(F.col(index) / F.lit(buffer)).cast("bigint")
    df = df.withColumn("_run", run * F.lit(buffer)).withColumn("_size", F.least(F.lit(buffer), F.col("_n") - F.col("_run")))
    # the run's number turns the inside of each run by a hash of its own before the rounds
    turned = (F.col(index) - F.col("_run") + _spread((F.col("_run") / F.lit(buffer)).cast("bigint") % F.lit(1 << 31), F.lit(seed))) % F.col("_size")
    return df.withColumn(out, F.col("_run") + permuted(turned, F.col("_size"), seed, epoch)).drop("_n", "_run", "_size")


def _full(df: DataFrame, size: int, rows: DataFrame | None, what: str) -> DataFrame:
    """``_usable`` = the rows in whole groups of ``size``, counted in the plan (over ``rows``: the table before its shuffle)."""
    n = (df if rows is None else rows).agg(F.count(F.lit(1)).alias("n")).scalar()
    few = F.raise_error(F.concat(F.lit("dataset has "), F.col("_n").cast("string"), F.lit(f" rows, fewer than {what} {size}"))).cast("bigint")
    usable = F.when(F.col("_n") < size, few).otherwise(F.floor(F.col("_n") / F.lit(size)).cast("bigint") * F.lit(size))
    return df.withColumn("_n", n).withColumn("_usable", usable).drop("_n")


def batch_rows(df: DataFrame, batch_size: int, pos: str = "pos", rows: DataFrame | None = None) -> DataFrame:
    """T4: ``batch = pos div B`` for full batches only (drop_last); fewer rows than B is an error of the job."""
    d = _full(df, batch_size, rows, "batch size").filter(F.col(pos) < F.col("_usable"))
    return d.withColumn("batch", (F.col(pos) / F.lit(batch_size)).cast("bigint")).drop("_usable")


def epoch_loop(df: DataFrame, batch_size: int, num_batches: int | None = None, pos: str = "pos", rows: DataFrame | None = None,
               epochs: int | None = None) -> DataFrame:
    """T5: ``num_batches`` batches (or ``epochs`` whole epochs and one batch), wrapping over epochs.

    A row at ``pos`` fills slots ``epoch * usable + pos``: each row lists its own slots,
    so that nothing is joined.
    """
    d = _full(df, batch_size, rows, "batch size").filter(F.col(pos) < F.col("_usable"))
    total = F.lit(num_batches * batch_size) if num_batches is not None else F.col("_usable") * F.lit(epochs or 1) + F.lit(batch_size)
    d = d.withColumn("_last", F.floor((total - 1 - F.col(pos)) / F.col("_usable")).cast("bigint")).filter(F.col("_last") >= 0)
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    d = d.withColumn("slot", F.col("epoch") * F.col("_usable") + F.col(pos))
    return d.withColumn("batch", (F.col("slot") / F.lit(batch_size)).cast("bigint")).drop("_usable", "_last")


def rank_split(df: DataFrame, world_size: int, rank: int, pos: str = "pos", rows: DataFrame | None = None) -> DataFrame:
    """Rows ``pos % world == rank`` after truncating to a multiple of ``world``."""
    d = _full(df, world_size, rows, "world size")
    return d.filter((F.col(pos) < F.col("_usable")) & (F.col(pos) % world_size == rank)).drop("_usable")


def sample_k(df: DataFrame, keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """K rows without replacement (smallest hashes), returned sorted by ``keys``."""
    return df.withColumn("_h", hash_key(*keys, seed=seed)).orderBy("_h", *keys).limit(k).drop("_h").orderBy(*keys)


#: Up to so many rows a group, Spark cuts a ranked window to them before the exchange.
_PARTIAL_LIMIT = 1000


def sample_k_per_episode(df: DataFrame, k: int, keys: Sequence[str] = ("episode_id",), t: str = "t", seed: int = 0,
                         overdraw: float = 1.0, keep: Column | None = None) -> DataFrame:
    """At most ``k`` frames per episode without replacement: over-draw, filter, cut.

    The ``int(k * overdraw)`` frames of the smallest hashes are drawn, those that fail
    ``keep`` left out, and the first ``k`` of the rest returned; without ``keep``, all
    drawn ones. The draw is a limit per group that every task applies to its own rows
    before the exchange, so a long episode leaves at most that many rows a task; draws
    of over 1000 are ranked in blocks instead.
    """
    draw = int(k * overdraw)
    h = df.withColumn("_h", hash_key(*keys, t, seed=seed))
    if draw <= _PARTIAL_LIMIT:
        r = h.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", t))).filter(F.col("_r") <= draw)
    else:
        r = index_within(h, list(keys), ["_h", t], out="_r", hashed=True).filter(F.col("_r") < draw)
    if keep is not None:  # few rows an episode are left
        r = r.filter(keep).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", t))).filter(F.col("_r") <= k)
    return r.drop("_h", "_r")


def choose_per_episode(options: Sequence[str], episode: str = "episode_id", seed: int = 0, epoch: int = 0):
    """One of several columns per episode (same choice for all its steps; new draw per epoch)."""
    arr = F.array(*[F.col(c) for c in options])
    idx = F.pmod(hash_key(episode, F.lit(epoch), seed=seed), F.lit(len(options)))
    return F.get(arr, idx.cast("int"))


def weighted_mix(spark: SparkSession, sources: Mapping[str, DataFrame], weights: Mapping[str, float], n: int,
                 order: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` output slots drawn from endlessly repeated sources by weight.

    Slot j draws ``u = hash(j)``; the source is the first whose cumulative
    weight exceeds u; the k-th slot of a source takes row ``k mod size`` of
    that source (in ``order``). Weights must sum to 1.
    """
    total = sum(weights.values())
    if abs(total - 1.0) > WEIGHT_TOLERANCE:
        raise ValueError(f"weights must sum to 1.0, got {total}")
    names = list(sources)
    cum, acc = [], 0.0
    for name in names:
        acc += weights[name]
        cum.append(acc)
    u = unit_hash("id", seed=seed)
    src = F.lit(names[-1])
    for name, c in reversed(list(zip(names[:-1], cum[:-1]))):
        src = F.when(u < F.lit(c), F.lit(name)).otherwise(src)
    slots = spark.range(n).select(F.col("id").alias("slot"), src.alias("source"))
    slots = index_within(slots, ["source"], ["slot"], out="_k")
    rows = None
    for name in names:
        r = sources[name].withColumn("source", F.lit(name))
        rows = r if rows is None else rows.unionByName(r, allowMissingColumns=True)
    rows = index_within(rows, ["source"], list(order), out="_row")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_size"))
    slots = join_small(slots, sizes, ["source"], known_small=True)
    slots = slots.withColumn("_row", F.col("_k") % F.col("_size")).drop("_k", "_size")
    return slots.join(rows, ["source", "_row"]).drop("_row")


def union_datasets(frames: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of same-feature datasets, tagged with their name."""
    out = None
    for name, df in frames.items():
        d = df.withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def retain_versions(df: DataFrame, group: Sequence[str], step: str, keep_period: int | None) -> DataFrame:
    """Keep the newest step per group plus every ``keep_period``-th step."""
    newest = df.groupBy(*group).agg(F.max(step).alias("_max"))
    j = join_small(df, newest, list(group))
    cond = F.col(step) == F.col("_max")
    if keep_period:
        cond = cond | (F.col(step) % F.lit(keep_period) == 0)
    return j.filter(cond).drop("_max")


def latest_version(df: DataFrame, group: Sequence[str], step: str, value: str) -> DataFrame:
    """Value at the largest step per group (``max_by``)."""
    return df.groupBy(*group).agg(F.max(step).alias(step), F.max_by(value, step).alias(value))


def next_seq(df: DataFrame, group: Sequence[str], n: str) -> DataFrame:
    """Next sequence number per group: ``max + 1``, 0 when empty."""
    return df.groupBy(*group).agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next_seq"))
