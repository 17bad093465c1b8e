"""Deterministic table masks that build detector truth from real tables.

Draws come from a hash of the row and a seed, so a mask gives the same rows on every run, on
every engine, and after a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundscope.functions.hashing import draw32, uniform
from roundscope.session import materialize

ROUND = ["job_id", "round_id"]


def compound_loss(worker_prob: Column, baseline: Column) -> Column:
    """Probability that at least one of two independent losses happens."""
    return F.lit(1.0) - (F.lit(1.0) - worker_prob) * (F.lit(1.0) - baseline)


def drop_rows(
    messages: DataFrame, losses: DataFrame, seed: int, baseline: float = 0.0
) -> DataFrame:
    """Drop rows with the probability given per worker, compounded with a baseline for all."""
    prob = compound_loss(F.coalesce("prob", F.lit(0.0)), F.lit(baseline))
    return (
        messages.join(losses, "worker_id", "left")
        .filter(uniform(F.col("seq"), F.lit(seed)) >= prob)
        .drop("prob")
    )


def skip_chunks(messages: DataFrame, skips: DataFrame) -> DataFrame:
    """Remove the named (worker, chunk) pairs."""
    return messages.join(skips, ["worker_id", "chunk_id"], "left_anti")


def remove_rounds(messages: DataFrame, rounds: DataFrame) -> DataFrame:
    """Remove whole (job, round) groups.

    Pass a written table as ``rounds`` (``session.materialize``): the optimizer then knows its
    size before it plans the join and does not shuffle the messages for a small list.
    """
    return messages.join(rounds.select(*ROUND), ROUND, "left_anti")


def delay_workers(messages: DataFrame, delays: DataFrame) -> DataFrame:
    """Shift the time of every row of the named workers."""
    return (
        messages.join(delays, "worker_id", "left")
        .withColumn("ts_us", F.col("ts_us") + F.coalesce("delay_us", F.lit(0)))
        .drop("delay_us")
    )


def seeded_worker(seed: Column, label: str, n_workers: int) -> Column:
    """The worker that a seed picks for a fault."""
    return (draw32(F.lit(label), seed) % n_workers).cast("int")


def sample_rounds(
    rounds: DataFrame, fraction: float, by: list[str], seed: Column, bins: int = 4096
) -> DataFrame:
    """Exactly ``max(1, round(n * fraction))`` rounds per group of ``by``, without replacement.

    The rounds with the smallest draws are taken. Draws are counted per bin first; every bin
    below the one that holds the k-th smallest draw is taken whole and only that one bin is
    ranked, so a group with very many rounds never becomes one sorted task.
    """
    drawn = (
        rounds.select(*by, "round_id")
        .withColumn("_u", uniform(F.lit("round"), *[F.col(k) for k in by if k != "seed"],
                                  F.col("round_id"), seed))
        .withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    )
    running = Window.partitionBy(*by).orderBy("_bin")
    whole = Window.partitionBy(*by)
    cuts = (
        drawn.groupBy(*by, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_all", F.sum("_n").over(whole))
        .withColumn(
            "_k",
            F.greatest(F.lit(1), F.bround(F.col("_all") * F.lit(fraction), 0)).cast("bigint"),
        )
        .withColumn("_left", F.col("_k") - (F.col("_upto") - F.col("_n")))
        .filter(F.col("_left") > 0)
        .select(*by, "_bin", "_n", "_left")
    )
    kept = drawn.join(cuts, [*by, "_bin"])
    rank = Window.partitionBy(*by, "_bin").orderBy("_u", "round_id")
    cut_bin = (
        kept.filter(F.col("_left") < F.col("_n"))
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= F.col("_left"))
    )
    whole_bins = kept.filter(F.col("_left") >= F.col("_n"))
    return whole_bins.select(*by, "round_id").unionByName(cut_bin.select(*by, "round_id"))


def intermittent_drops(
    messages: DataFrame, fault_rounds: DataFrame, worker: Column, prob: float, seed: int
) -> DataFrame:
    """Drop one worker's rows with ``prob``, only in the given rounds.

    The worker's first row of a fault round always goes, so every fault round loses something;
    the truth set is the rounds the mask touched. The list of first rows is written out for the
    same reason as in ``remove_rounds``.
    """
    first = (
        messages.filter(F.col("worker_id") == worker)
        .join(fault_rounds.select(*ROUND), ROUND, "left_semi")
        .groupBy(*ROUND)
        .agg(F.min("seq").alias("_first_seq"))
    )
    first = materialize(first, "first-losses")
    hit = (
        (F.col("worker_id") == worker)
        & F.col("_first_seq").isNotNull()
        & ((F.col("seq") == F.col("_first_seq"))
           | (uniform(F.col("seq"), F.lit(seed)) < F.lit(prob)))
    )
    return messages.join(first, ROUND, "left").filter(~hit).drop("_first_seq")
