from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from epiframe.session import checkpoint_dir

    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def small_blocks(monkeypatch):
    """Tiny blocks, ranges and segments, so that every border lies inside the test data."""
    from epiframe.plans import ordered

    monkeypatch.setattr(ordered, "BLOCK_BITS", 2)
    monkeypatch.setattr(ordered, "RANGE_BITS", 2)
    monkeypatch.setattr(ordered, "SEGMENT", 8)
