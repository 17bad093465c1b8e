"""Cross-job correlation of per-round metrics.

Inputs have one row per (job, round). The number of job pairs is part of the answer, so pairs
are joined on the round and spread over tiles of job groups: a round shared by very many jobs
becomes many small tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundscope.functions.numeric import half_even, safe_corr

PAIR = ["job_a", "job_b"]


def pair_rounds(
    left: DataFrame, right: DataFrame, tiles: int = 4, directed: bool = False
) -> DataFrame:
    """Rows of ``left`` (job_a) and ``right`` (job_b) of the same round with job_a < job_b.

    ``directed`` keeps both directions of a pair, for metrics that are not the same on both sides.
    Both sides have ``job_id, round_id`` plus their own metric columns. With ``tiles`` = T the
    jobs fall into T groups by hash; every left row goes to the T tiles of its group's row,
    every right row to the T tiles of its group's column, so each pair meets in one tile.
    """
    group = F.pmod(F.hash("job_id"), F.lit(tiles))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    a = left.withColumn("_row", group).withColumn("_col", every)
    b = right.withColumn("_col", group).withColumn("_row", every)
    a = a.withColumnRenamed("job_id", "job_a")
    b = b.withColumnRenamed("job_id", "job_b")
    return (
        a.join(b, ["round_id", "_row", "_col"])
        .filter(F.col("job_a") != F.col("job_b") if directed else F.col("job_a") < F.col("job_b"))
        .drop("_row", "_col")
    )


def configured_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """As ``pair_rounds`` but only for the given (job_a, job_b) pairs."""
    a = left.withColumnRenamed("job_id", "job_a")
    b = right.withColumnRenamed("job_id", "job_b")
    return a.join(pairs, "job_a").join(b, ["job_b", "round_id"])


def pairwise_corr(latencies: DataFrame, min_rounds: int = 3) -> DataFrame:
    """Pearson correlation of the latencies of every job pair over their common rounds."""
    long_enough = (
        latencies.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_rounds)
    )
    rows = latencies.join(long_enough, "job_id", "left_semi")
    x = rows.select("job_id", "round_id", F.col("latency_us").cast("double").alias("x"))
    y = rows.select("job_id", "round_id", F.col("latency_us").cast("double").alias("y"))
    return (
        pair_rounds(x, y)
        .groupBy(*PAIR)
        .agg(F.count(F.lit(1)).alias("rounds"), safe_corr("x", "y").alias("corr"))
        .filter(F.col("rounds") >= min_rounds)
        .select(*PAIR, "rounds", half_even(F.col("corr"), 6).alias("corr"))
    )


def carry_rows(
    df: DataFrame, keys: list[str], order: str, values: list[str], n: int, block: int
) -> DataFrame:
    """Add ``_block`` and repeat, ahead of each block, the ``n`` rows that precede it.

    A ROWS frame of ``n`` preceding rows can then be computed per (keys, block) instead of per
    key, with the repeated rows (``_carried``) dropped afterwards; a key with very many rows is
    no longer one task. ``n`` rows back from a block may lie several blocks away, but never more
    than ``n`` non-empty blocks, so the tails of the ``n`` previous blocks are enough.
    """
    own = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn(
        "_carried", F.lit(False)
    )
    last = Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc())
    tails = (
        own.withColumn("_rank", F.row_number().over(last))
        .filter(F.col("_rank") <= n)
        .groupBy(*keys, "_block")
        .agg(F.collect_list(F.struct(order, *values)).alias("_tail"))
    )
    previous = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-n, -1)
    recent = F.slice(
        F.reverse(F.array_sort(F.flatten(F.collect_list("_tail").over(previous)))), 1, n
    )
    carried = (
        tails.select(*keys, "_block", recent.alias("_recent"))
        .select(*keys, "_block", F.inline("_recent"))
        .withColumn("_carried", F.lit(True))
    )
    return own.unionByName(carried.select(*own.columns))


def sliding_corr(
    pairs: DataFrame,
    x: Column,
    y: Column,
    window_size: int = 8,
    by: list[str] | None = None,
    block_rounds: int = 65_536,
) -> DataFrame:
    """Correlation over the last ``window_size`` observed rounds; only full windows are kept.

    Rows are counted, not round numbers: a lost round shortens nothing, the window reaches
    further back.
    """
    keys = by or PAIR
    kept = [c for c in pairs.columns if c not in (*keys, "round_id")]
    rows = pairs.withColumn("_x", x.cast("double")).withColumn("_y", y.cast("double"))
    rows = carry_rows(
        rows, keys, "round_id", [*kept, "_x", "_y"], window_size - 1, block_rounds
    )
    frame = (
        Window.partitionBy(*keys, "_block").orderBy("round_id").rowsBetween(-(window_size - 1), 0)
    )
    return (
        rows.withColumn("_rows", F.count(F.lit(1)).over(frame))
        .withColumn("score", half_even(safe_corr("_x", "_y", frame), 6))
        .filter((F.col("_rows") == window_size) & ~F.col("_carried"))
        .select(*keys, "round_id", *kept, "score")
    )


def correlation_alerts(
    scores: DataFrame, threshold: float = 0.75, export_latency_us: int = 0
) -> DataFrame:
    """Windows at or above the threshold; export latency delays the detection time."""
    return scores.filter(F.col("score") >= threshold).withColumn(
        "detected_us", F.col("detected_us") + export_latency_us
    )


def first_detections(
    alerts: DataFrame,
    intervals: DataFrame,
    window_size: int,
    keys: list[str],
    group: list[str] | None = None,
) -> DataFrame:
    """Earliest alert of each interval, searched in ``[start, end + window)``.

    The equality ``keys`` carry the join and the range condition is checked within them;
    ``group`` (default ``keys``) tells detections apart, for instance by job pair. The earliest
    alert is a partial aggregate, so a key with very many alerts stays small.
    """
    group = group or keys
    a = alerts.select(*group, F.col("round_id").alias("alert_round"), "detected_us")
    hit = (F.col("alert_round") >= F.col("start_round")) & (
        F.col("alert_round") < F.col("end_round") + window_size
    )
    return (
        a.join(intervals, keys)
        .filter(hit)
        .groupBy(*group, "start_round", "end_round")
        .agg(
            F.min(F.struct("detected_us", "alert_round")).alias("_first"),
            F.count(F.lit(1)).alias("detections"),
        )
        .select(
            *group, "start_round", "end_round", "detections",
            F.col("_first.alert_round").alias("alert_round"),
            F.col("_first.detected_us").alias("detected_us"),
        )
    )
