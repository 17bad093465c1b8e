"""Keyed aggregations per round: latency, contributions, stragglers, completeness.

Every aggregate here combines on the map side, so a job or round that holds a large share of
all rows sends only a few partial rows per task to its reducer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundscope.session import BROADCAST_ROW_LIMIT, materialize

ROUND = ["job_id", "round_id"]
WORKER = ["job_id", "round_id", "worker_id"]


def round_latency(messages: DataFrame) -> DataFrame:
    """First to last message of each round."""
    return messages.groupBy(*ROUND).agg(
        (F.max("ts_us") - F.min("ts_us")).alias("latency_us"),
    )


def worker_counts(messages: DataFrame, weight: str | None = None) -> DataFrame:
    """Messages per (job, round, worker); ``weight`` sums a count column of compressed input."""
    cnt = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    return messages.groupBy(*WORKER).agg(cnt.alias("cnt"))


def complete_counts(counts: DataFrame, workers: int) -> DataFrame:
    """Counts of every configured worker in every observed round; a silent worker has 0.

    The zeros are rows that are summed with the counts, so there is no join.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("worker_id")
    silent = counts.select(*ROUND).distinct().select(
        *ROUND, every, F.lit(0).cast("bigint").alias("cnt")
    )
    return counts.select(*WORKER, "cnt").unionByName(silent).groupBy(*WORKER).agg(
        F.sum("cnt").alias("cnt")
    )


def usual(table: DataFrame, value: str) -> DataFrame:
    """Median of ``value`` for each job, from its distinct values and how often they occur."""
    return table.groupBy("job_id").agg(F.median(value).alias("usual"))


#: Room for an arrival number below a time in one whole number of 38 digits.
_ARRIVALS = 10**19


def packed_order(later_first: bool = False) -> Column:
    """Time, then arrival, as one number of fixed width, so that aggregates over it can hash.

    ``later_first`` turns arrivals around: among equal times the earlier arrival ranks higher.
    """
    time = F.col("ts_us").cast("decimal(18,0)") * F.lit(str(_ARRIVALS)).cast("decimal(20,0)")
    arrival = F.lit(2**63 - 1) - F.col("seq") if later_first else F.col("seq")
    return (time + arrival.cast("decimal(19,0)")).cast("decimal(38,0)")


def arrival_rank() -> Column:
    """Orders messages by time; among equal times the earlier arrival ranks higher."""
    return packed_order(later_first=True)


def straggler(messages: DataFrame) -> DataFrame:
    """Worker of the last message of each round; the first arrival wins ties.

    The last time per worker is a hash aggregate over plain numbers, several times cheaper than
    carrying (time, arrival) pairs through every message. It names the worker unless several
    share a round's last time; only for such rounds are messages looked at again, by a broadcast
    of the rounds while those are few, and by the pairs for all messages otherwise.
    """
    last = messages.groupBy(*WORKER).agg(F.max("ts_us").alias("ts_us"))
    leaders = (
        last.groupBy(*ROUND, "ts_us")
        .agg(F.count(F.lit(1)).alias("n"), F.min("worker_id").alias("worker_id"))
        .groupBy(*ROUND)
        .agg(F.max(F.struct("ts_us", "n", "worker_id")).alias("_last"))
        .select(*ROUND, "_last.*")
    )
    leaders = materialize(leaders, "round-leaders")
    single = leaders.filter(F.col("n") == 1).select(*ROUND, "worker_id")
    tied = leaders.filter(F.col("n") > 1).select(*ROUND, "ts_us")
    ties = tied.limit(BROADCAST_ROW_LIMIT + 1).count()
    if ties == 0:
        return single
    if ties > BROADCAST_ROW_LIMIT:
        return messages.groupBy(*ROUND).agg(
            F.max_by("worker_id", arrival_rank()).alias("worker_id")
        )
    first = (
        messages.join(F.broadcast(tied), [*ROUND, "ts_us"])
        .groupBy(*ROUND)
        .agg(F.min_by("worker_id", "seq").alias("worker_id"))
    )
    return single.unionByName(first)


def _extreme_row(messages: DataFrame, keys: list[str], pick: Callable, order: Column) -> DataFrame:
    """The row of each key that ``pick`` (``min_by`` or ``max_by``) chooses, as a full row.

    One hash aggregate per column over plain numbers: each task sends one row per key, whatever the
    key's size, and no message is sorted. Time and arrival together must name a message.
    """
    chosen = [pick(c, order).alias(c) for c in messages.columns if c not in keys]
    return messages.groupBy(*keys).agg(*chosen).select(*messages.columns)


def worker_tail(messages: DataFrame) -> DataFrame:
    """Last message of each worker in each round; the first arrival wins ties."""
    return _extreme_row(messages, WORKER, F.max_by, arrival_rank())


def distinct_first(messages: DataFrame, keys: list[str]) -> DataFrame:
    """First message per key."""
    return _extreme_row(messages, keys, F.min_by, packed_order())


def distinct_pairs(messages: DataFrame) -> DataFrame:
    """Distinct (worker, chunk) pairs per round, counted in two levels: pairs, then rounds."""
    return (
        messages.groupBy(*ROUND, "worker_id", "chunk_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*ROUND)
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


def incomplete_rounds(messages: DataFrame, expected_pairs: int) -> DataFrame:
    """Observed rounds with a flag for missing pairs; absent rounds stay absent."""
    return distinct_pairs(messages).withColumn("incomplete", F.col("pairs") < expected_pairs)


def lossy_worker(counts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Lowest-count worker among those below their job's ``expected_chunks``.

    Ties go to the lowest worker id; rounds where every worker is full are absent.
    """
    return (
        counts.join(jobs.select("job_id", "expected_chunks"), "job_id")
        .filter(F.col("cnt") < F.col("expected_chunks"))
        .groupBy(*ROUND)
        .agg(F.min(F.struct("cnt", "worker_id")).alias("_low"))
        .select(*ROUND, F.col("_low.worker_id").alias("worker_id"), F.col("_low.cnt").alias("cnt"))
    )


def gap_rounds(
    counts: DataFrame, worker: Column | int, min_gap: int = 1, by: list[str] | None = None,
    cnt: str = "cnt",
) -> DataFrame:
    """Rounds whose count spread is at least ``min_gap`` and whose lowest worker is ``worker``."""
    worker = F.lit(worker) if isinstance(worker, int) else worker
    return (
        counts.groupBy(*(by or ROUND))
        .agg(
            F.max(cnt).alias("max_cnt"),
            F.min(cnt).alias("min_cnt"),
            F.min(F.struct(cnt, "worker_id")).alias("_low"),
        )
        .filter(
            (F.col("max_cnt") - F.col("min_cnt") >= min_gap)
            & (F.col("_low.worker_id") == worker)
        )
        .drop("_low")
    )


def tail_gap(messages: DataFrame, threshold_us: int, by: list[str] | None = None) -> DataFrame:
    """Gap between the last two messages of each round, flagged from ``threshold_us`` on.

    Rounds with a single message have no gap and are absent. The rank filter is applied before
    the shuffle as well (a window group limit), so each task sends at most two rows per round.
    """
    keys = by or ROUND
    order = Window.partitionBy(*keys).orderBy(F.col("ts_us").desc())
    return (
        messages.select(*keys, "ts_us")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= 2)
        .groupBy(*keys)
        .agg(
            (F.max("ts_us") - F.min("ts_us")).alias("gap_us"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .filter(F.col("_rows") == 2)
        .select(*keys, "gap_us", (F.col("gap_us") >= threshold_us).alias("alert"))
    )


def merge_ordered(streams: list[DataFrame]) -> DataFrame:
    """All streams as one table in time order; equal times keep stream, then arrival order."""
    tagged = [df.withColumn("stream_id", F.lit(i)) for i, df in enumerate(streams)]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df)
    return merged.orderBy("ts_us", "stream_id", "seq")


def named_reducers(value: str) -> dict[str, list[Column]]:
    """Mergeable built-in aggregates by name.

    ``arg_max`` orders messages by arrival and returns the worker, ``set_union`` returns the distinct
    values as a sorted array (for bounded domains such as expected pairs).
    """
    return {
        "sum": [F.sum(value).alias("value")],
        "count": [F.count(value).alias("value")],
        "min_max": [F.min(value).alias("lo"), F.max(value).alias("hi")],
        "arg_max": [F.max_by("worker_id", arrival_rank()).alias("value")],
        "set_union": [F.array_sort(F.collect_set(value)).alias("value")],
    }


def reduce_by_key(df: DataFrame, keys: list[str], value: str, reducer: str) -> DataFrame:
    """Keyed reduction with one named reducer."""
    return df.groupBy(*keys).agg(*named_reducers(value)[reducer])


def reduce_by_key_all(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All named reducers in one pass, each as a struct under its name."""
    every = [F.struct(*columns).alias(name) for name, columns in named_reducers(value).items()]
    return df.groupBy(*keys).agg(*every)


def fold_by_key(
    df: DataFrame,
    keys: list[str],
    order: str,
    lift: Column,
    merge: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column],
    piece_rows: int = 4096,
    levels: int | None = None,
) -> DataFrame:
    """Keyed fold with a caller-supplied associative ``merge``, applied in ``order``.

    ``lift`` turns a row into an accumulator. A key is cut into pieces of ``piece_rows``
    consecutive ``order`` values (a unique non-negative integer), pieces are folded, then
    pieces of pieces, so no task holds a whole key however many rows it has: after L levels
    one array holds at most ``max(order) / piece_rows ** L`` accumulators. Without ``levels`` the
    tree is as deep as the largest order value asks for, so that no array is longer than a piece.
    """
    if levels is None:
        levels, reach = 0, (df.agg(F.max(order)).first()[0] or 0) + 1
        while reach > piece_rows:
            levels, reach = levels + 1, -(-reach // piece_rows)
    step = df.select(*keys, F.col(order).cast("bigint").alias("_pos"), lift.alias("_acc"))
    for level in range(levels + 1):
        piece = [] if level == levels else [F.floor(F.col("_pos") / piece_rows).alias("_piece")]
        items = F.array_sort(F.collect_list(F.struct("_pos", "_acc")))
        folded = F.reduce(
            F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))),
            items[0]["_acc"],
            lambda acc, item: merge(acc, item["_acc"]),
        )
        step = step.groupBy(*keys, *piece).agg(folded.alias("_acc"))
        if piece:
            step = step.withColumnRenamed("_piece", "_pos")
    return step.select(*keys, finish(F.col("_acc")).alias("value"))
