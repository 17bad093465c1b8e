"""Properties of physical plans that the scale of the data depends on."""

from __future__ import annotations

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_points
from roundscope.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(catalog.BATCH["flt_events"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(value)" in text and "GreaterThan(value,20.0)" in text
    latency = plan(catalog.BATCH["q1_round_latency"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp,event_type:string>" in latency


@pytest.mark.parametrize("name", ["q3_tail_gap"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    text = plan(catalog.BATCH[name](spark, SF_DIR))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


@pytest.mark.parametrize("name", ["q1_round_latency", "q2_worker_counts", "distinct_first", "round_tail"])
def test_one_shuffle_with_partial_aggregation(spark, name):
    text = plan(catalog.BATCH[name](spark, SF_DIR))
    assert text.count("Exchange") == 1 and "partial_" in text


@pytest.mark.parametrize("name", ["distinct_first", "round_tail", "q1_round_latency"])
def test_messages_are_not_sorted(spark, name):
    """Orders are numbers of fixed width, so rows are picked by hashing."""
    assert "SortAggregate" not in plan(catalog.BATCH[name](spark, SF_DIR))


def test_estimates_need_no_shuffle_of_keys(spark):
    """Keys keep the partitioning of their counts; only the bounded cell table moves."""
    text = plan(catalog.BATCH["sketch_point_estimate"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning(job_id") == 2  # counts, once per use
    assert text.count("Exchange hashpartitioning(depth_row") == 1


def test_entry_is_lazy(spark):
    assert entry_points.entry(spark).columns == [
        "job_id", "round_id", "detected_us", "observed", "expected", "reason"
    ]
