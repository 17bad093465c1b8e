"""Scoring of detector output against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundscope.functions.numeric import half_even, safe_div


def with_precision_recall(
    counts: DataFrame, tp: str = "tp", pp: str = "pp", ap: str = "ap"
) -> DataFrame:
    """Add precision and recall, 0.0 when nothing was predicted or nothing was actual."""
    return counts.withColumn(
        "precision", half_even(safe_div(F.col(tp), F.col(pp)), 3)
    ).withColumn("recall", half_even(safe_div(F.col(tp), F.col(ap)), 3))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def lowest_worker_scores(
    rows: DataFrame, by: list[str], worker: str, truth: str, predictions: dict[str, Column],
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Lowest-count-worker scoring of several detectors in one pass over worker counts.

    ``rows`` has ``(*by, worker, job_id, round_id, worker_id, truth)``. Each prediction is a
    count column, null where the detector does not consider that worker. Predicted positives
    count only rounds where ``worker`` itself is predicted. Ties go to the lowest worker id.
    ``sums`` names row values to add up beside the scores.
    """
    sums = sums or {}

    def lowest(cnt: Column) -> Column:
        return F.min(
            F.when(cnt.isNotNull(), F.struct(cnt.alias("cnt"), F.col("worker_id")))
        )["worker_id"]

    names = list(predictions)
    per_round = rows.groupBy(*by, worker, "job_id", "round_id").agg(
        lowest(F.col(truth)).alias("_truth"),
        F.count(F.lit(1)).alias("_keys"),
        *[F.sum(value).alias(name) for name, value in sums.items()],
        *[lowest(predictions[name]).alias(f"_{name}") for name in names],
    )
    actual = F.col("_truth") == F.col(worker)
    scored = per_round.groupBy(*by, worker).agg(
        F.sum("_keys").cast("bigint").alias("keys"),
        *[F.sum(name).cast("bigint").alias(name) for name in sums],
        count_if(actual).alias("ap"),
        *[count_if(F.col(f"_{n}") == F.col(worker)).alias(f"_pp_{n}") for n in names],
        *[count_if(actual & (F.col(f"_{n}") == F.col(worker))).alias(f"_tp_{n}") for n in names],
    )
    systems = F.array(*[
        F.struct(
            F.lit(n).alias("system"), F.col(f"_tp_{n}").alias("tp"), F.col(f"_pp_{n}").alias("pp")
        )
        for n in names
    ])
    return with_precision_recall(
        scored.select(*by, worker, "keys", *sums, "ap", F.inline(systems))
    )


def set_flags(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of either side with ``predicted`` and ``actual`` flags.

    Built by a union and one grouping, so both sides are shuffled once and no side has to fit
    in memory.
    """
    zero, one = F.lit(0), F.lit(1)
    both = predicted.select(*keys, one.alias("p"), zero.alias("a")).unionByName(
        actual.select(*keys, zero.alias("p"), one.alias("a"))
    )
    return both.groupBy(*keys).agg(
        (F.max("p") == 1).alias("predicted"), (F.max("a") == 1).alias("actual")
    )


def set_score(flags: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall of predicted against actual keys, with the false positives."""
    p, a = F.col("predicted"), F.col("actual")
    return with_precision_recall(
        flags.groupBy(*by).agg(
            count_if(p & a).alias("tp"),
            count_if(p).alias("pp"),
            count_if(a).alias("ap"),
            count_if(p & ~a).alias("fp"),
        )
    )


def false_positive_rate(fp: Column, healthy: Column) -> Column:
    return half_even(safe_div(fp, F.greatest(healthy, F.lit(1))), 6)


def average_delay_ms(delay_us: Column) -> Column:
    """Mean of a delay in milliseconds, 0.0 when there is none."""
    return half_even(F.coalesce(F.avg(delay_us / F.lit(1000.0)), F.lit(0.0)), 3)
