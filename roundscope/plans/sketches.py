"""Sketch queries over worker counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.functions.hashing import key_text
from roundscope.operators import rounds, sketch
from roundscope.plans import settings as S
from roundscope.plans.base import WORKER, event_counts, events, keyed, named

#: Columns kept by each sketch key, in order of growing detail.
KEY_COLUMNS = {
    "worker": ["worker_id"],
    "job_worker": ["job_id", "worker_id"],
    "job_round_worker": WORKER,
}


def sketch_table(spark: SparkSession, sf: str) -> DataFrame:
    counts = keyed(rounds.worker_counts(events(spark, sf)))
    return sketch.sketch_table(counts, width=S.SKETCH_WIDTH)


def estimated(spark: SparkSession, sf: str) -> DataFrame:
    counts = keyed(rounds.worker_counts(events(spark, sf)))
    table = sketch.sketch_table(counts, width=S.SKETCH_WIDTH)
    return sketch.point_estimates(counts, table, [*WORKER, "cnt"], width=S.SKETCH_WIDTH)


def sketch_point_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return estimated(spark, sf)


def sketch_heavy_hitters(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.heavy_hitters(estimated(spark, sf), S.HEAVY_THRESHOLD).select(*WORKER, "est")


def sketch_levels(spark: SparkSession, sf: str) -> DataFrame:
    columns = KEY_COLUMNS["job_worker"]
    counts = events(spark, sf).groupBy(*columns).agg(F.count(F.lit(1)).alias("cnt"))
    return sketch.level_tables(keyed(counts, columns), S.SKETCH_LEVELS, width=S.SKETCH_WIDTH)


def estimates_by_mode(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Estimates under each sketch key, shared back to the fine keys."""
    parts = None
    for position, (mode, columns) in enumerate(KEY_COLUMNS.items()):
        part = sketch.shared_estimates(
            counts, WORKER, columns, key_text(*map(F.col, columns)), S.SKETCH_WIDTH, by=by,
            sketches=len(S.SEEDS) if by else 1,
        ).select(F.lit(mode).alias("key_mode"), F.lit(position).alias("mode_order"), "*")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def sketch_key_modes(spark: SparkSession, sf: str) -> DataFrame:
    return estimates_by_mode(event_counts(spark, sf))


QUERIES = named(
    sketch_table, sketch_point_estimate, sketch_heavy_hitters, sketch_levels, sketch_key_modes
)
