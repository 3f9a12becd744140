"""Session set-up and small plan helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for episode tables: AQE on, UTC, UI off.

    On a cluster the existing session is returned untouched apart from
    settings that are unset.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("epiframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def size_shuffle_partitions(spark: SparkSession, input_bytes: int, per_partition: int = 128 << 20,
                            expansion: float = 1.0) -> int:
    """Set ``spark.sql.shuffle.partitions`` so each shuffle partition holds about
    ``per_partition`` bytes (``expansion`` > 1 for steps that widen rows, e.g.
    chunks of H actions). Never lowers an explicit larger setting; AQE then
    coalesces small partitions and splits skewed ones at runtime.
    """
    want = max(1, int(input_bytes * expansion // per_partition) + 1)
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(current, want)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` if set.

    Only when nothing is configured and the master is local (tests) a scratch
    folder is made; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="epiframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               known_small: bool = False) -> DataFrame:
    """Join a side expected to be small, broadcasting it only when its size is checked.

    * ``known_small``: the side is bounded by construction (a literal list,
      one row per key × dim of a stats table) → broadcast hint.
    * default: a plain join. AQE measures the side's real shuffle size at
      runtime and turns the join into a broadcast join only under
      ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise it stays a
      sort-merge join (skew-split by AQE). No extra job.
    """
    if known_small:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def r6(c) -> Column:
    """Round a double to 6 decimals the same way in Spark and in SQL.

    ``floor(x * 1e6 + 0.49997) / 1e6`` is plain IEEE arithmetic, so both
    engines land on the same double. The cut sits at fraction .50003, not .5:
    averages of short decimals often end exactly in 5 at the 7th place, where
    one ulp of summation-order noise would flip a half-way rounding.
    """
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c * F.lit(1_000_000.0) + F.lit(ROUND_CUT)) / F.lit(1_000_000.0)).cast("double")


ROUND_CUT = 0.49997
