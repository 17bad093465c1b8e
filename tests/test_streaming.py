"""Streams fed file by file must give what the batch form gives."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from roundscope.operators import rounds as round_ops
from roundscope.plans import base, correlation, per_round, stream
from roundscope.streaming import stateful


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The events in time order as several files, oldest first."""
    root = str(tmp_path_factory.mktemp("feed"))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    for part in range(6):
        chunk = events.filter(F.floor((F.dayofmonth("ts") - 1) / 5) == part)
        chunk.coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    return root


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_correlation_state_carries_over_batches(spark, many_files):
    got = stream.stream_corr_alerts(spark, many_files, max_files=1)
    assert rows(got) == rows(correlation.q5_corr_alerts(spark, SF_DIR))


def test_closed_rounds_over_many_batches(spark, many_files):
    replay, messages = stream.replay_events(spark, many_files, max_files=1)
    got = replay.to_table(stream.monitors.round_latency(messages, stream.LENGTH))
    assert rows(got) == rows(per_round.q1_round_latency(spark, SF_DIR))


def test_first_rows_over_many_batches(spark, many_files):
    replay, messages = stream.replay_events(spark, many_files, max_files=2)
    got = replay.to_table(stream.monitors.distinct_first(messages, base.WORKER, stream.LENGTH))
    expected = round_ops.distinct_first(base.events(spark, SF_DIR), base.WORKER)
    assert rows(got) == rows(expected)


def test_totals_under_a_plan_with_offsets_and_gaps(spark, many_files):
    """The same rows as from the batch table, and nothing is kept when all rounds are over."""
    replay, messages = stream.replay_events(spark, many_files, max_files=1)
    jobs = base.materialize(stream.shifted_jobs(spark, many_files), "jobs")
    plan = base.materialize(stream.schedule(jobs), "plan")
    placed = stateful.scheduled(messages, stream.on(replay, jobs))
    told = replay.to_table(
        stateful.monitor_rounds(placed, stream.on(replay, plan), stream.S.TIMEOUT_US)
    )
    assert replay.late_rows == 0
    kept = replay.session.read.format("statestore").option("stateVarName", "plan")
    kept = kept.option("operatorId", 0).load(f"{replay.root}/checkpoint")
    assert kept.count() == 0
    period = F.col("round_duration_us") + F.col("inter_round_gap_us")
    since = F.col("ts_us") - F.col("start_offset_us")
    found = base.events(spark, SF_DIR).drop("round_id").join(jobs, "job_id").filter(
        (since >= 0) & (F.pmod(since, period) < F.col("round_duration_us"))
    ).withColumn("round_id", F.floor(since / period).cast("int")).filter("round_id < n_rounds")
    totals = found.groupBy("job_id", "round_id").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")
    )
    expected = plan.select("job_id", "round_id").join(
        totals, ["job_id", "round_id"], "left").fillna(0, ["n"])
    got = told.filter("kind = 'round'").select("job_id", "round_id", "first_us", "last_us", "n")
    def keyed(df):
        return {r[:2]: r[2:] for r in map(tuple, df.select(*got.columns).collect())}
    assert keyed(got) == keyed(expected)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    late = events.limit(7).select(*[
        F.lit("2024-01-01").cast("timestamp_ntz").alias(c) if c == "ts" else c for c in events.columns
    ])
    newest = events.filter("ts > timestamp_ntz'2024-01-20'")
    for part in (newest, newest.limit(3), late):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    replay, messages = stream.replay_events(spark, str(tmp_path), max_files=1)
    rounds = replay.to_table(stream.monitors.tumbling_counts(messages, stream.LENGTH))
    assert replay.late_rows > 0
    assert rounds.filter(f"start_us < {base.S.EVENT_START_US + 86_400_000_000}").count() == 0


class Held:
    """State of one key, as a processor sees it."""

    def __init__(self):
        self.value, self.items, self.timers = None, {}, []
        self.getValueState = self.getMapState = lambda *_: self
        self.exists = lambda: self.value is not None
        self.get, self.keys = (lambda: self.value), (lambda: list(self.items))
        self.containsKey, self.getValue = self.items.__contains__, self.items.__getitem__
        self.updateValue, self.removeKey = self.items.__setitem__, self.items.pop
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove
        self.listTimers = lambda: self.timers

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None
        self.items.clear()


def test_ring_waits_for_both_halves_and_retires():
    step = stateful.PairCorrelator(3, 1_000_000, 10_000, 0)
    held = Held()
    step.init(held)

    def feed(*halves):
        rows = [stateful.Row(round_id=r, latency=x, active=y) for r, x, y in halves]
        return [tuple(r) for r in step.handleInputRows((1, 2), iter(rows), None)]

    assert feed((0, 1.0, None), (1, 2.0, None), (0, None, 0.0)) == []
    assert feed((1, None, 1.0), (2, 3.0, None)) == []
    assert feed((3, 5.0, None), (3, None, 1.0)) == [(1, 2, 3, pytest.approx(0.6933752452815365))]
    assert held.items == {} and held.value[0] == [0, 1, 3]  # round 2 never got its other half
    assert feed((4, 0.0, 0.0)) == [(1, 2, 4, pytest.approx(stateful.pearson([2, 5, 0], [1, 1, 0])))]
    assert held.timers == [1_050]
    list(step.handleExpiredTimer((1, 2), None, None))
    assert held.value is None


def test_correlation_of_constants_is_zero():
    assert stateful.pearson([1.0, 1.0], [0.0, 1.0]) == 0.0
