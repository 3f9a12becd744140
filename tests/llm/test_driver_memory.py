"""What the driver holds while an operator runs its stored tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm import common
from epiframe.llm.common import sieve, sift, stored


def _full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_storing_a_table_collects_the_drivers_garbage(spark, monkeypatch):
    monkeypatch.setattr(common, "_COLLECTED", [-np.inf])
    before = _full_collections(spark)
    out = stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "garbage")
    once = _full_collections(spark)
    assert once > before
    again = stored(out.groupBy("count").agg(F.count("k").alias("n")), "garbage")  # the last collection was just now
    assert sorted(map(tuple, again.collect())) == [(14, 5), (15, 2)]
    assert sorted(map(tuple, out.collect())) == [(k, 15 if k < 2 else 14) for k in range(7)]
    assert len(common._COLLECTED) == 1 and common._COLLECTED[0] > 0


def test_sieve_makes_no_row_objects(spark, monkeypatch):
    rng = np.random.default_rng(3)
    held, others = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 5000))
    df = spark.createDataFrame([(int(h),) for h in held], "h long")

    def collect(self):
        raise AssertionError("rows were collected as objects")

    monkeypatch.setattr(DataFrame, "collect", collect)
    monkeypatch.setattr(type(df), "collect", collect)
    bits = sieve(df, "h")
    wanted = np.zeros(1 << common.SIEVE_BITS, dtype=bool)
    wanted[held & ((1 << common.SIEVE_BITS) - 1)] = True
    assert sift(bits, held).all()
    assert (sift(bits, others) == wanted[others & ((1 << common.SIEVE_BITS) - 1)]).all()
    assert not sieve(df.limit(0), "h").any()


_SIZES = "n long, size long"


def _batch_sizes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})


def test_texts_reach_workers_in_batches_bounded_by_bytes(spark):
    key, before = common._BATCH_CONF, spark.conf.get(common._BATCH_CONF, None)
    spark.conf.unset(key)
    try:
        out = stored(spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("x"), 2000).alias("text")), "batches")
        got = out.mapInArrow(_batch_sizes, _SIZES).collect()
        assert sum(r.n for r in got) == 9000
        assert max(r.size for r in got) < common.BATCH_BYTES + 100_000
        spark.conf.set(key, "1m")  # what the user sets holds
        common.bound_batches(spark)
        assert spark.conf.get(key) == "1m"
        assert max(r.size for r in out.mapInArrow(_batch_sizes, _SIZES).collect()) < 1_200_000
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_stored_tables_have_small_row_groups(spark, monkeypatch):
    from urllib.parse import unquote, urlparse

    import pyarrow.parquet as pq

    monkeypatch.setattr(common, "GROUP_BYTES", 1 << 20)
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(16)])
    rows = spark.range(0, 4000, 1, 1).select("id", text.alias("text"))
    out = stored(rows, "groups")
    groups = [pq.ParquetFile(unquote(urlparse(f).path)).metadata.num_row_groups for f in out.inputFiles()]
    assert max(groups) > 1
    assert out.exceptAll(rows).isEmpty() and out.count() == 4000
