"""Masked tables with known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.functions.tables import parameter_table
from roundscope.operators import mask, rounds
from roundscope.plans import settings as S
from roundscope.plans.base import ROUND, WORKER, events, every, named, observed_rounds
from roundscope.session import materialize


def mask_drop(spark: SparkSession, sf: str) -> DataFrame:
    losses = parameter_table(spark, "worker_id int, prob double", [(3, 0.2), (5, 0.05)])
    return mask.drop_rows(events(spark, sf), losses, seed=0, baseline=0.02).select("seq", *WORKER)


def mask_skip(spark: SparkSession, sf: str) -> DataFrame:
    skips = parameter_table(spark, "worker_id int, chunk_id int", [(3, 0), (5, 1), (6, 1)])
    return mask.skip_chunks(events(spark, sf), skips).select("seq", *WORKER, "chunk_id")


def sampled(observed: DataFrame, fraction: float) -> DataFrame:
    """Sampled rounds of each job, for every seed."""
    return mask.sample_rounds(
        observed.select(*ROUND, every(S.SEEDS, "seed")), fraction, ["seed", "job_id"],
        F.col("seed"),
    )


def sample_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return sampled(observed_rounds(spark, sf), S.FAULT_FRACTION)


def first_seed_faults(spark: SparkSession, sf: str, fraction: float) -> DataFrame:
    faults = sampled(observed_rounds(spark, sf), fraction).filter(F.col("seed") == 0)
    return materialize(faults, "fault-rounds")


def mask_rounds(spark: SparkSession, sf: str) -> DataFrame:
    failed = first_seed_faults(spark, sf, S.FAULT_FRACTION)
    return mask.remove_rounds(events(spark, sf), failed).select("seq", *WORKER)


def mask_delay(spark: SparkSession, sf: str) -> DataFrame:
    delays = parameter_table(
        spark, "worker_id int, delay_us bigint", [(2, S.HOUR_US), (7, 90_000_000)]
    )
    return mask.delay_workers(events(spark, sf), delays).select("seq", *WORKER, "ts_us")


def mask_intermittent(spark: SparkSession, sf: str) -> DataFrame:
    """Worker counts after intermittent loss of one worker, with the truth flag per round."""
    faults = first_seed_faults(spark, sf, S.INTERMITTENT_FRACTION)
    kept = mask.intermittent_drops(
        events(spark, sf), faults, F.lit(S.FAULT_WORKER), S.INTERMITTENT_PROB, seed=0
    )
    truth = faults.select(*ROUND, F.lit(True).alias("_fault"))
    return (
        rounds.worker_counts(kept)
        .join(truth, ROUND, "left")
        .select(*WORKER, "cnt", F.coalesce("_fault", F.lit(False)).alias("fault_round"))
    )


QUERIES = named(
    sample_rounds, mask_drop, mask_skip, mask_rounds, mask_delay, mask_intermittent
)
