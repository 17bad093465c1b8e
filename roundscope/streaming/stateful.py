"""Monitors with keyed state of their own: a schedule with timers, and rings of recent rounds.

Messages never reach a Python worker: they are first combined into time buckets or rounds, per task,
by built-in aggregates, and only those few rows go on to the keyed state. State is kept in RocksDB
under the checkpoint of the query and ends with the round, or when a pair of jobs is retired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roundscope.operators.schedule import round_start
from roundscope.streaming.monitors import LATENESS, ROUND

HOUR_US = 3_600_000_000


# --- rounds of a schedule ------------------------------------------------------------------

def scheduled(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Put each message of a stream into the round of its job's schedule, by its time alone.

    ``jobs`` is the job dimension; rounds start at an offset and may have gaps between them. Adds
    ``round_id`` and the flag ``inside``: messages in a gap, before the first or after the last
    round, or of a job that is not configured belong to no round.
    """
    period = F.col("round_duration_us") + F.col("inter_round_gap_us")
    since = F.col("ts_us") - F.col("start_offset_us")
    nth = F.floor(since / period)
    inside = (nth >= 0) & (nth < F.col("n_rounds")) & (
        F.pmod(since, period) < F.col("round_duration_us")
    )
    own = [c for c in messages.columns if c != "round_id"]
    return messages.drop("round_id").join(
        jobs.select("job_id", "n_rounds", "start_offset_us", "round_duration_us",
                    "inter_round_gap_us"), "job_id", "left",
    ).select(
        *own, F.when(inside, nth.cast("int")).alias("round_id"),
        F.coalesce(inside, F.lit(False)).alias("inside"),
    )


def stream_buckets(messages: DataFrame, width_us: int) -> DataFrame:
    """First and last time and count per round and time bucket, each when its bucket closes.

    Messages that are not ``inside`` any round count for the watermark alone. The filter names ``ts``,
    as it would else be moved ahead of the watermark.
    """
    timed = messages.withWatermark("ts", LATENESS)
    if "inside" in messages.columns:
        timed = timed.filter(F.col("inside") | F.col("ts").isNull())
    return (
        timed
        .groupBy(F.window("ts", f"{width_us} microseconds"), *ROUND)
        .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
             F.count(F.lit(1)).alias("n"))
        .select(*ROUND, "first_us", "last_us", "n")
    )


PLAN = "start_us bigint, end_us bigint, expected bigint"
PROGRESS = "seen bigint, idle_from bigint, first_us bigint, fired_us bigint, observed bigint, told boolean"
MONITOR_SCHEMA = (
    "job_id int, round_id int, kind string, first_us bigint, last_us bigint, n bigint, "
    "detected_us bigint, observed bigint, expected bigint, reason string"
)

MonitorRow = Row(*[field.split()[0] for field in MONITOR_SCHEMA.split(", ")])


def after(time_us: int) -> int:
    """The first whole millisecond that is not before a time."""
    return math.ceil(time_us / 1000)


class RoundMonitor(StatefulProcessor):
    """State of one scheduled round, from its start in the schedule to its end.

    The schedule is the initial state and arms a timer per round, so a round that never sends
    anything is noticed as well. A timer stands at the moment from which the round counts as
    inactive, and one at its end; both wait one bucket longer, as a bucket arrives when it has
    closed. Rows of rounds that are not in the schedule keep no state.
    """

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", PLAN)
        self.progress = handle.getValueState("progress", PROGRESS)

    def _arm(self, idle_from: int) -> None:
        self.handle.registerTimer(after(idle_from + 2 * self.timeout_us))

    def _done_at(self, end_us: int) -> int:
        return after(end_us + 2 * self.timeout_us)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        plan = (initialState.start_us, initialState.end_us, initialState.expected)
        self.plan.update(plan)
        self.progress.update((0, plan[0], None, None, None, False))
        self._arm(plan[0])
        self.handle.registerTimer(self._done_at(plan[1]))

    def _alert(self, key: Any, fired_us: int, observed: int, expected: int, reason: str) -> Row:
        return MonitorRow(*key, "alert", None, None, None, fired_us, observed, expected, reason)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not self.plan.exists():
            return
        _, _, expected = self.plan.get()
        seen, idle_from, first, fired, observed, told = self.progress.get()
        for row in sorted(rows, key=lambda r: r.first_us):
            due = idle_from + self.timeout_us
            if fired is None and seen < expected and row.first_us > due:
                fired, observed = due, seen
            seen += row.n
            idle_from = max(idle_from, row.last_us)
            first = row.first_us if first is None else min(first, row.first_us)
        if fired is not None and observed == 0 and not told:
            told = True
            yield self._alert(key, fired, 0, expected, "missing-round")
        self.progress.update((seen, idle_from, first, fired, observed, told))
        if fired is None and seen < expected:
            self._arm(idle_from)

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        if not self.plan.exists():
            return
        _, end_us, expected = self.plan.get()
        seen, idle_from, first, fired, observed, told = self.progress.get()
        now, due = expiredTimerInfo.getExpiryTimeInMs(), idle_from + self.timeout_us
        over = now >= self._done_at(end_us)
        if fired is None and seen < expected and (over or now >= after(due + self.timeout_us)):
            fired, observed = due, seen
        if fired is not None and not told and (observed == 0 or over):
            # Whether a total came too late or never is known at the end of the round only.
            told = True
            late = "premature-timeout" if seen >= expected else "missing-pairs"
            reason = "missing-round" if observed == 0 else late
            yield self._alert(key, fired, observed, expected, reason)
        if over:
            last = idle_from if first is not None else None
            yield MonitorRow(*key, "round", first, last, seen, None, None, expected, None)
            self.plan.clear()
            self.progress.clear()
        else:
            self.progress.update((seen, idle_from, first, fired, observed, told))

    def close(self) -> None:
        pass


def monitor_rounds(messages: DataFrame, schedule: DataFrame, timeout_us: int) -> DataFrame:
    """Alerts and closing rows of all scheduled rounds (:data:`MONITOR_SCHEMA`).

    ``schedule`` (``job_id, round_id, start_us, end_us, expected``) is a static table. ``kind`` is
    ``alert``, or ``round`` for the totals of a round when it is over, absent rounds included.
    """
    initial = schedule.select(*ROUND, "start_us", "end_us", "expected").groupBy(*ROUND)
    return stream_buckets(messages, timeout_us).groupBy(*ROUND).transformWithState(
        RoundMonitor(timeout_us), MONITOR_SCHEMA, "append", "eventTime", initialState=initial
    )


# --- deadlines -----------------------------------------------------------------------------

def deadline_alerts(messages: DataFrame, schedule: DataFrame, length: str) -> DataFrame:
    """Rounds below their expected total at the deadline, as an outer join of two streams.

    ``schedule`` streams ``job_id, round_id, ts`` (start), ``deadline_us, expected``. Totals close
    with their window; a scheduled round waits for its total until the watermark has passed every
    time at which it could still come, and is then emitted alone and forgotten.
    """
    totals = (
        messages.withWatermark("ts", LATENESS).groupBy(F.window("ts", length), *ROUND)
        .agg(F.count(F.lit(1)).alias("observed"))
        .select(
            F.window_time("window").alias("closed"), F.col("job_id").alias("_job"),
            F.col("round_id").alias("_round"), "observed",
        )
    )
    planned = schedule.withWatermark("ts", LATENESS)
    within = F.expr(f"closed >= ts AND closed <= ts + INTERVAL {length}")
    same = (F.col("job_id") == F.col("_job")) & (F.col("round_id") == F.col("_round"))
    observed = F.coalesce("observed", F.lit(0)).cast("bigint")
    return (
        planned.join(totals, same & within, "left_outer")
        .withColumn("observed", observed)
        .filter(F.col("observed") < F.col("expected"))
        .select(
            *ROUND, F.col("deadline_us").alias("detected_us"), "observed", "expected",
            F.when(F.col("observed") == 0, "missing-round").otherwise("missing-pairs")
            .alias("reason"),
        )
    )


# --- sliding correlation -------------------------------------------------------------------

PAIR = ["job_a", "job_b"]
RING = "rounds array<int>, latency array<double>, active array<double>"
WAITING = "latency double, active double"
SCORE_SCHEMA = "job_a int, job_b int, round_id int, score double"
ScoreRow = Row("job_a", "job_b", "round_id", "score")


def pearson(xs: list[float], ys: list[float]) -> float:
    """Correlation of two equally long series; 0.0 where one of them is constant."""
    mean_x, mean_y = sum(xs) / len(xs), sum(ys) / len(ys)
    dx, dy = [x - mean_x for x in xs], [y - mean_y for y in ys]
    spread = math.sqrt(sum(d * d for d in dx)) * math.sqrt(sum(d * d for d in dy))
    return sum(a * b for a, b in zip(dx, dy)) / spread if spread else 0.0


class PairCorrelator(StatefulProcessor):
    """The last rounds of one directed pair of jobs, as a ring of fixed length.

    Both halves of a round (latency of one job, activity of the other) come on their own and wait
    for each other; a half is given up when a later round is complete. A pair that has been silent
    for ``retire_us`` since its last round loses its state.
    """

    def __init__(self, size: int, retire_us: int, period_us: int, start_us: int):
        self.size, self.retire_us = size, retire_us
        self.period_us, self.start_us = period_us, start_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", RING)
        self.waiting = handle.getMapState("waiting", "round_id int", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        halves: dict[int, list] = {}
        for row in rows:
            half = halves.get(row.round_id)
            if half is None:
                known = self.waiting.containsKey((row.round_id,))
                half = list(self.waiting.getValue((row.round_id,))) if known else [None, None]
                halves[row.round_id] = half
            half[0] = row.latency if row.latency is not None else half[0]
            half[1] = row.active if row.active is not None else half[1]
        ring = [list(part) for part in self.ring.get()] if self.ring.exists() else [[], [], []]
        for round_id, half in sorted(halves.items()):
            if None in half:
                if not ring[0] or round_id > ring[0][-1]:
                    self.waiting.updateValue((round_id,), tuple(half))
                continue
            for part, value in zip(ring, (round_id, *half)):
                part.append(value)
                del part[: -self.size]
            if len(ring[0]) == self.size:
                yield ScoreRow(*key, round_id, pearson(ring[1], ring[2]))
        if ring[0]:
            self.ring.update(tuple(ring))
            for (given_up,) in [k for k in self.waiting.keys() if k[0] <= ring[0][-1]]:
                self.waiting.removeKey((given_up,))
        newest = max([*halves, *ring[0][-1:]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end_us = self.start_us + (newest + 1) * self.period_us
        self.handle.registerTimer(after(end_us + self.retire_us))

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        self.ring.clear()
        self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_scores(
    metrics: DataFrame, usual: DataFrame, pairs: DataFrame, size: int, retire_us: int,
    period_us: int, start_us: int,
) -> DataFrame:
    """Score of every full window of every configured pair, as rounds close.

    ``metrics`` streams closed rounds (``job_id, round_id, latency_us, n``); ``usual`` says what a
    round of each job usually has, and ``pairs`` (``job_a, job_b``) which latency is held against
    whose activity. Both are static tables. Each closed round goes to the pairs that its job is in.
    """
    active = (F.col("n") > F.col("usual")).cast("double")
    ends = F.array(
        F.struct(F.col("job_a").alias("job_id"), F.lit(True).alias("victim"), *PAIR),
        F.struct(F.col("job_b").alias("job_id"), F.lit(False).alias("victim"), *PAIR),
    )
    sides = pairs.select(F.inline(ends))
    nothing = F.lit(None).cast("double")
    halves = metrics.join(usual, "job_id").join(sides, "job_id").select(
        *PAIR, "round_id",
        F.when(F.col("victim"), F.col("latency_us") / 1e6).otherwise(nothing).alias("latency"),
        F.when(~F.col("victim"), active).otherwise(nothing).alias("active"),
    )
    return halves.groupBy(*PAIR).transformWithState(
        PairCorrelator(size, retire_us, period_us, start_us), SCORE_SCHEMA, "append", "eventTime"
    )


# --- alerts in episodes --------------------------------------------------------------------

def alerts_in_episodes(alerts: DataFrame, episodes: DataFrame, tail: str, longest: str) -> DataFrame:
    """Alerts that fall into ``[start, end + tail)`` of an episode of their victim.

    Both are streams: ``alerts`` with a time ``ts``, ``episodes`` with ``start`` and ``end``. No
    episode is longer than ``longest``, so both sides can be dropped once the watermark is that far.
    """
    late = alerts.withWatermark("ts", LATENESS)
    open_ones = episodes.withWatermark("start", LATENESS).withColumnRenamed("job_a", "_victim")
    during = F.expr(
        f"ts >= start AND ts < end + INTERVAL {tail} "
        f"AND ts <= start + INTERVAL {longest} + INTERVAL {tail}"
    )
    return late.join(open_ones, (F.col("job_a") == F.col("_victim")) & during).drop("_victim")
