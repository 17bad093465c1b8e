"""Bound tables and the small tables derived from them that several queries share.

Tables with one row per round, worker or time bucket are written out once: the messages are
then read and aggregated a single time however often a plan uses the result, and the optimizer
knows the size of what it joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.functions.hashing import key_text
from roundscope.operators import inactivity, rounds
from roundscope.operators.schedule import schedule
from roundscope.plans import settings as S
from roundscope.session import materialize
from roundscope.sources import bindings

ROUND, WORKER = rounds.ROUND, rounds.WORKER
PAIR = ["job_a", "job_b"]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.event_messages(bindings.load(spark, sf, "events"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.line_messages(bindings.load(spark, sf, "lineitem"))


def keyed(counts: DataFrame, columns: list[str] = WORKER) -> DataFrame:
    """Counts with the canonical sketch key of the given columns."""
    return counts.withColumn("key", key_text(*map(F.col, columns)))


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(rounds.worker_counts(events(spark, sf)), "worker-counts")


def event_buckets(
    spark: SparkSession, sf: str, width_us: int = S.TIMEOUT_US, by: list[str] | None = None
) -> DataFrame:
    buckets = inactivity.activity_buckets(events(spark, sf), width_us, by)
    return materialize(buckets, "activity-buckets")


def round_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Latency and message count of each round."""
    metrics = events(spark, sf).groupBy(*ROUND).agg(
        (F.max("ts_us") - F.min("ts_us")).alias("latency_us"), F.count(F.lit(1)).alias("n")
    )
    return materialize(metrics, "round-metrics")


def usual_counts(metrics: DataFrame) -> DataFrame:
    """How many messages a round of each job usually has."""
    return materialize(rounds.usual(metrics, "n"), "usual-counts")


def observed_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(events(spark, sf).select(*ROUND).distinct(), "observed-rounds")


def event_schedule(observed: DataFrame, timeout_us: int = S.TIMEOUT_US) -> DataFrame:
    """Schedule of the jobs seen in ``observed`` (``job_id, round_id``), two rounds ahead."""
    return schedule(
        bindings.event_jobs(observed), timeout_us, F.lit(S.EXPECTED_ROUND)
    ).withColumn("timeout_us", F.lit(timeout_us).cast("bigint"))


def round_start_us(round_id: str = "round_id") -> Column:
    return F.lit(S.EVENT_START_US) + F.col(round_id).cast("bigint") * F.lit(S.DAY_US)


def every(values: tuple, name: str) -> Column:
    """One row per value of a short parameter list."""
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def every_seed(**columns: Callable[[Column], Column]) -> Column:
    """One row per seed with values that depend on it; all are constants before the query runs."""
    return F.inline(F.array(*[
        F.struct(
            F.lit(seed).alias("seed"), *[f(F.lit(seed)).alias(n) for n, f in columns.items()]
        )
        for seed in S.SEEDS
    ]))


def named(*functions) -> dict:
    return {f.__name__: f for f in functions}
