"""Every named query against its SQL counterpart on an independent engine."""

from __future__ import annotations

import os

import pytest
from compare import compare
from conftest import SF_DIR

import __spark_entry__ as entry_points

# Queries of the corpus part have tests of their own.
QUERIES, ORACLES = entry_points.ROUND_QUERIES, entry_points.ROUND_ORACLES


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    rows = frame.collect()
    assert rows, "no rows"
    assert compare(frame.columns, rows, names, cursor.fetchall()) == ""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_expected_totals(spark):
    """Totals worked out beforehand for the small tables."""
    if not SF_DIR.endswith("sf0.01"):
        pytest.skip("totals are for sf0.01")
    reasons = {
        r["reason"]: r["count"]
        for r in QUERIES["q4_inactivity_alerts"](spark, SF_DIR).groupBy("reason").count().collect()
    }
    assert reasons == {"missing-pairs": 28, "premature-timeout": 18, "missing-round": 11}
    incomplete = QUERIES["q4_incomplete_rounds"](spark, SF_DIR).filter("source = 'events'")
    assert incomplete.filter("incomplete").count() == 37


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_detectors_find_something_at_every_size(spark, size):
    """Expectations follow the data, and pairs of jobs stand in both directions."""
    sf_dir = f"{os.path.dirname(SF_DIR)}/{size}"
    if not os.path.isdir(sf_dir):
        pytest.skip("no such tables")
    low = QUERIES["q2_lossy_worker"](spark, sf_dir).count()
    assert 0 < low < QUERIES["q1_round_latency"](spark, sf_dir).count() / 4
    alerts = QUERIES["q5_corr_alerts"](spark, sf_dir)
    assert alerts.filter("job_a < job_b").count() > 0 and alerts.filter("job_a > job_b").count() > 0


def test_silent_workers_are_named(spark):
    """In rounds 14 and 20 of job `view`, one of eight workers sends nothing."""
    if not SF_DIR.endswith("sf0.01"):
        pytest.skip("known for sf0.01")
    low = QUERIES["q2_lossy_worker"](spark, SF_DIR).filter("job_id = 4 and round_id in (14, 20)")
    assert [r.cnt for r in low.collect()] == [0, 0]
