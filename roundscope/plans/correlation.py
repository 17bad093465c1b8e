"""Cross-job correlation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.functions.hashing import uniform
from roundscope.operators import correlate
from roundscope.operators.schedule import episodes
from roundscope.plans import settings as S
from roundscope.plans.base import (
    PAIR, ROUND, named, round_metrics, round_start_us, usual_counts,
)
from roundscope.sources import bindings


def paired_metrics(metrics: DataFrame, usual: DataFrame) -> DataFrame:
    """Latency of job_a beside the activity of job_b, with the round end as detection time.

    A job is active in a round in which it sends more than it usually does. Latency and activity
    are different metrics, so each pair of jobs stands in both directions.
    """
    activity = metrics.join(usual, "job_id").select(
        *ROUND, (F.col("n") > F.col("usual")).alias("active")
    )
    return correlate.pair_rounds(
        metrics.select(*ROUND, "latency_us"), activity, directed=True
    ).select(
        *PAIR, "round_id", "latency_us", "active",
        (round_start_us() + F.lit(S.DAY_US)).alias("detected_us"),
    )


def sliding(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Full-window scores of ``latency_us`` against ``active``."""
    return correlate.sliding_corr(
        rows, F.col("latency_us") / 1e6, F.col("active").cast("int"), S.CORR_WINDOW, by
    )


def alerts(metrics: DataFrame) -> DataFrame:
    return correlate.correlation_alerts(
        sliding(paired_metrics(metrics, usual_counts(metrics))), S.CORR_THRESHOLD, S.EXPORT_LATENCY_US
    )


def q5_pairwise_corr(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.pairwise_corr(round_metrics(spark, sf).drop("n"))


def q5_sliding_corr(spark: SparkSession, sf: str) -> DataFrame:
    metrics = round_metrics(spark, sf)
    pairs = paired_metrics(metrics, usual_counts(metrics))
    return sliding(pairs).select(*PAIR, "round_id", "score")


def q5_sliding_corr_lossy(spark: SparkSession, sf: str) -> DataFrame:
    """Some per-round metrics never reach the correlator; windows close over the rest."""
    draw = uniform(F.lit("export"), F.col("job_a"), F.col("job_b"), F.col("round_id"))
    metrics = round_metrics(spark, sf)
    pairs = paired_metrics(metrics, usual_counts(metrics)).filter(draw >= S.EXPORT_DROP_PROB)
    return sliding(pairs).select(*PAIR, "round_id", "score")


def q5_corr_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(round_metrics(spark, sf)).select(*PAIR, "round_id", "detected_us", "score")


def episode_first_detection(spark: SparkSession, sf: str) -> DataFrame:
    """First alert of each pair in each activity episode of job_a, and its delay."""
    metrics = round_metrics(spark, sf)
    intervals = episodes(bindings.event_jobs(metrics)).withColumnRenamed("job_id", "job_a")
    first = correlate.first_detections(
        alerts(metrics), intervals, S.CORR_WINDOW, ["job_a"], PAIR
    )
    return first.withColumn(
        "ttd_ms", (F.col("detected_us") - round_start_us("start_round")) / 1000.0
    )


QUERIES = named(
    q5_pairwise_corr, q5_sliding_corr, q5_sliding_corr_lossy, q5_corr_alerts,
    episode_first_detection,
)
