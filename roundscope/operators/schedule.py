"""Expected rounds: the job dimension expanded to one row per scheduled round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds expanded from one array; bounds the memory a job with very many rounds needs.
EXPAND_BLOCK = 65_536


def round_start(round_id: Column) -> Column:
    period = F.col("round_duration_us") + F.col("inter_round_gap_us")
    return F.col("start_offset_us") + round_id * period


def schedule(jobs: DataFrame, timeout_us: int = 0, expected: Column | None = None) -> DataFrame:
    """One row per scheduled (job, round) with start, end, deadline and expected total.

    ``jobs`` has ``job_id, n_workers, n_chunks, n_rounds, start_offset_us, round_duration_us,
    inter_round_gap_us``. The expected total is workers x chunks unless ``expected`` is given.
    """
    last = F.col("n_rounds") - 1
    block_first = F.col("_block") * EXPAND_BLOCK
    block_last = F.least(last, block_first + (EXPAND_BLOCK - 1))
    total = expected if expected is not None else F.col("n_workers") * F.col("n_chunks")
    start = round_start(F.col("round_id").cast("bigint"))
    end = start + F.col("round_duration_us")
    return (
        jobs.filter(F.col("n_rounds") > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(last / EXPAND_BLOCK))))
        .withColumn("round_id", F.explode(F.sequence(block_first, block_last)))
        .select(
            "job_id",
            F.col("round_id").cast("int").alias("round_id"),
            start.alias("start_us"),
            end.alias("end_us"),
            (end + timeout_us).alias("deadline_us"),
            total.cast("bigint").alias("expected"),
        )
    )


def episodes(jobs: DataFrame) -> DataFrame:
    """Half-open activity intervals ``[start_round, end_round)`` derived from the round count.

    Short jobs (below ten rounds) get one interval, longer ones up to two.
    """
    n = F.col("n_rounds")
    fifth = F.floor(n / 5)
    length = F.greatest(F.lit(3), fifth)
    first = F.greatest(F.lit(1), fifth)
    first_end = F.least(n, first + length)
    second = F.least(n - 1, F.greatest(first_end + 2, F.floor(n * 3 / 5)))
    second_end = F.least(n, second + length)

    def interval(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start_round"), end.cast("int").alias("end_round"))

    third = F.greatest(F.lit(0), F.floor(n / 3))
    short = F.array(interval(third, n))
    long = F.array(interval(first, first_end), interval(second, second_end))
    return (
        jobs.select("job_id", F.inline(F.when(n < 10, short).otherwise(long)))
        .filter(F.col("start_round") < F.col("end_round"))
    )


def in_episode(rounds: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rounds`` that fall in some interval of the same keys (range semi-join)."""
    inside = (rounds.round_id >= intervals.start_round) & (rounds.round_id < intervals.end_round)
    same = [rounds[k] == intervals[k] for k in keys]
    condition = inside
    for equal in same:
        condition = condition & equal
    return rounds.join(intervals, condition, "left_semi")
