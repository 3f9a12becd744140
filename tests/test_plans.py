"""Plan checks: no pair-emitting joins anywhere, pruned scans for the flagship."""

from __future__ import annotations

import contextlib
import io

import pytest

from tests.conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _batch_queries():
    from epiframe.plans.catalog import queries

    return sorted(n for n in queries() if not n.startswith("stream_"))


@pytest.mark.parametrize("name", _batch_queries())
def test_no_cartesian_or_nested_loop(spark, name):
    from epiframe.plans.catalog import queries

    plan = _plan(queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_scan_is_pruned(spark):
    from epiframe.plans.catalog import queries

    plan = _plan(queries()["norm_stats_pipeline"](spark, SF001))
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("event_type" not in s for s in schemas)
    # windows run per (episode, block) or (episode, segment), never per whole episode
    exchanges = [line for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning(episode_id")]
    assert any("_block" in e for e in exchanges) and any("_seg" in e for e in exchanges)
    assert "Arguments: SinglePartition" not in plan
