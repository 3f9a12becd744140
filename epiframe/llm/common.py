"""Helpers of the corpus operators: stored tables, row numbering, hashed words."""

from __future__ import annotations

import gc
import math
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

ASCII_SPACE = (0x20, 9, 10, 11, 12, 13)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


#: Bytes of an Arrow batch that goes to a Python worker, and of a stored table's row groups. Both stand
#: whole in memory for every running task, some of them several times (JVM, worker, buffers that double).
BATCH_BYTES, GROUP_BYTES = 4 << 20, 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless that was set: 10,000 texts have no bound."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: later stages, and retries after a lost executor, read the
    files instead of running the plan again.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Seconds between two collections of the driver's garbage, and when the last one was.
GARBAGE_SECONDS = 5.0
_COLLECTED = [-math.inf]


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, in Python and in the JVM, unless it was done just now.

    Spark drops the shuffle files and broadcasts of finished plans only when the driver
    collects garbage (by itself every half hour: ``spark.cleaner.periodicGC.interval``);
    between collections its heap also grows with the number of plans run. An operator
    runs dozens, each ending in a stored table that later ones read instead.
    """
    if time.monotonic() - _COLLECTED[0] < GARBAGE_SECONDS:
        return
    gc.collect()
    spark._jvm.System.gc()
    release_memory()
    _COLLECTED[0] = time.monotonic()


#: Paths of the tables stored in each open ``temporary_tables`` block.
_SCOPES: list[list[str]] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables stored inside go at the end, but for the one given to ``keep``: nothing else may be read after."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        _delete(spark, made)


def keep(df: DataFrame) -> DataFrame:
    """Let a stored table outlive its ``temporary_tables`` block (it falls to the block around, if any)."""
    path = df._stored_at
    for n in range(len(_SCOPES) - 1, -1, -1):
        if path in _SCOPES[n]:
            _SCOPES[n].remove(path)
            if n:
                _SCOPES[n - 1].append(path)
            break
    return df


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that later ones stand for."""
    for df in tables:
        for made in _SCOPES:
            if df._stored_at in made:
                made.remove(df._stored_at)
        _delete(df.sparkSession, [df._stored_at])


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(col: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str,
                rows_per_block: int = 50_000) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... with no key held by one task.

    A row's block is a hash of its order columns, so the rows of a hot key are
    spread over many blocks; rows are numbered inside (key, block) and the blocks'
    counts are summed up per key. The numbering is gapless; it follows the blocks,
    then ``order``. ``df`` must be a stored table (it is read twice).
    """
    blocks = max(1, math.ceil(df.count() / rows_per_block))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (df.withColumn("_rn", F.row_number().over(within)).join(counts, on)
            .withColumn(out, F.col("_before") + F.col("_rn") - 1)
            .drop("_block", "_rn", "_before", "_b", *[f"_k{i}" for i in range(len(keys))]))


def running_total(df: DataFrame, order: list[str], value: str, out: str,
                  rows_per_range: int = 100_000) -> DataFrame:
    """Add the sum of ``value`` over all rows that stand before a row in ``order``.

    Rows are range-partitioned by ``order`` and stored with their range's number;
    ranges are summed up on a table with one row per range, rows inside their range.
    """
    ranges = max(1, math.ceil(df.count() / rows_per_range))
    df = (df.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order])
          .withColumn("_range", F.spark_partition_id()))
    df = stored(df, "ranges")
    totals = df.groupBy("_range").agg(F.sum(value).alias("_t")).withColumnRenamed("_range", "_r")
    bounds = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("_r", F.coalesce(F.sum("_t").over(bounds), F.lit(0)).alias("_b"))
    inside = (Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    return (df.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(totals, F.col("_range") == F.col("_r"))
            .withColumn(out, F.col("_b") + F.col("_i")).drop("_range", "_r", "_b", "_i"))


SIEVE_BITS = 22


def sieve(df: DataFrame, col: str) -> np.ndarray:
    """Bitmap (2^22 bits, always) of the low bits of a hash column: what it lacks, ``col`` lacks.

    It grows with neither rows nor values; a full one lets everything pass.
    """
    low = F.col(col).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))")
    words = df.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # no object a word
    out = np.zeros(1 << (SIEVE_BITS - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def sift(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the sieve."""
    low = values.view(np.uint64) & _U((1 << SIEVE_BITS) - 1)
    return ((bits[(low >> _U(6)).astype(np.int64)] >> (low & _U(63))) & _U(1)).astype(bool)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
    for upper in range(65, 91) if fold else ():  # A-Z count as a-z
        values[upper] = values[upper + 32]
    return values


_FOLDED, _EXACT = _byte_values(True), _byte_values(False)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)
_STEP = _U(0xD1342543DE82EF95)
_BACK = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        full = np.full(max(n, 1 << 20), _STEP)
        full[0] = 1
        _POWERS = np.multiply.accumulate(full)
        full[1:] = _BACK
        _INVERSES = np.multiply.accumulate(full)
    return _POWERS, _INVERSES


class Words:
    """Words of a batch of texts as 64-bit hashes with their byte places.

    ``hashes``, ``starts``, ``ends`` (bytes in the joined buffer) and ``docs`` (row)
    hold one entry per word, in text order; ``first[i]:first[i+1]`` are row i's.
    With ``fold``, A-Z hash as a-z. ``is_word``: a table of bytes, or a function that
    says of all bytes at once which belong to words.
    """

    def __init__(self, texts: pa.Array, is_word, fold: bool = True):
        data, offsets = text_bytes(texts)
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = is_word(data) if callable(is_word) else is_word[data]
        turn = np.diff(inside)
        begins, ends = turn[:-1] == 1, turn[1:] == -1
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        if len(cuts):  # a row's end also ends a word
            whole = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            begins[whole] = True
            ends[whole - 1] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        powers, inverses = _powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[data] * powers[:n], out=self._sums[1:])
        self._inverses = inverses
        self.hashes = self.span_hash(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.docs = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes in each [start, end), wherever they stand."""
        return mix64((self._sums[ends] - self._sums[starts]) * self._inverses[starts] + (ends - starts).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets in them; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def not_bytes(codes) -> np.ndarray:
    """Table of word bytes: all but ``codes``."""
    out = np.ones(256, dtype=np.int8)
    out[list(codes)] = 0
    return out


SPACED = not_bytes(ASCII_SPACE)
#: Digits, letters and all bytes beyond ASCII.
ALNUM = not_bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


#: Rows of one batch, and bits of a shingle's hash: together they are one sortable word.
MAX_ROWS, HASH_BITS = 4096, 52


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct ``size``-word shingles, sorted, and rows' bounds in them.

    A row of fewer words has its whole sequence as one shingle; without words, none.
    Hashes have 52 bits; a batch has at most 4096 rows.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    n = len(h)
    acc = mix64(h + _U(1))
    for j in range(1, size):
        acc[:n - j] = mix64(acc[:n - j] + h[j:] * _ODD + _U(j))
    keep = first[words.docs + 1] - np.arange(n) >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    docs, values = words.docs[keep], acc[keep]
    if len(short):
        value = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            there = counts[short] > j
            value[there] = mix64(value[there] + h[first[short[there]] + j] * _ODD + _U(j + 1000 * size))
        docs, values = np.concatenate([docs, short]), np.concatenate([values, value])
    key = (docs.astype(np.uint64) << _U(HASH_BITS)) | (values >> _U(64 - HASH_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(len(counts) + 1, dtype=np.uint64) << _U(HASH_BITS)) if len(counts) < MAX_ROWS else \
        np.append(np.searchsorted(key, np.arange(len(counts), dtype=np.uint64) << _U(HASH_BITS)), len(key))
    return key & _U((1 << HASH_BITS) - 1), bounds


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its stage, and what its
    allocators keep would count against the executor in all later ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def row_runs(texts: pa.Array, limit: int = 1_000_000):
    """Runs of rows of about ``limit`` bytes and at most ``MAX_ROWS`` rows: (first, past the last).
    Behind the last one freed memory is given back."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right"))
        end = min(max(at + 1, end), at + MAX_ROWS)
        yield at, end
        at = end
    release_memory()
