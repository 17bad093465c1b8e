"""Streaming plans. Each takes streaming messages with an event time ``ts``.

Grouping always includes an event-time window, so the watermark bounds the state, and every
aggregate combines on the map side, so a busy key does not overload its state partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.functions.hashing import key_text
from roundscope.operators import sketch
from roundscope.operators.rounds import ROUND, WORKER, arrival_rank, packed_order

#: How late a message may be; fixed value of the replays.
LATENESS = "1 hour"


def by_round(messages: DataFrame, keys: list[str], length: str):
    """Messages grouped by ``keys`` within the event-time window of their round."""
    return messages.withWatermark("ts", LATENESS).groupBy(F.window("ts", length), *keys)


def round_latency(messages: DataFrame, length: str) -> DataFrame:
    return by_round(messages, ROUND, length).agg(
        (F.max("ts_us") - F.min("ts_us")).alias("latency_us")
    ).select(*ROUND, "latency_us")


def round_metrics(messages: DataFrame, length: str) -> DataFrame:
    return by_round(messages, ROUND, length).agg(
        (F.max("ts_us") - F.min("ts_us")).alias("latency_us"), F.count(F.lit(1)).alias("n")
    ).select(*ROUND, "latency_us", "n")


def worker_counts(messages: DataFrame, length: str) -> DataFrame:
    """Running counts; in update mode each batch yields the keys that changed."""
    return by_round(messages, WORKER, length).agg(F.count(F.lit(1)).alias("cnt")).select(
        *WORKER, "cnt"
    )


def straggler(messages: DataFrame, length: str) -> DataFrame:
    return by_round(messages, ROUND, length).agg(
        F.max_by("worker_id", arrival_rank()).alias("worker_id")
    ).select(*ROUND, "worker_id")


def tumbling_counts(messages: DataFrame, length: str) -> DataFrame:
    """Messages per job and tumbling window, emitted when the window closes."""
    return by_round(messages, ["job_id"], length).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros("window.start").alias("start_us"), "job_id", "n"
    )


def distinct_first(messages: DataFrame, keys: list[str], length: str) -> DataFrame:
    """First message per key, as a full row, when its round closes.

    Deduplication by aggregation: the first row is a partial aggregate, while a streaming
    ``dropDuplicates`` would shuffle every row of a busy key and keep whichever came first.
    """
    rest = [c for c in messages.columns if c not in ("ts", *keys)]
    first = [F.min_by(c, packed_order()).alias(c) for c in rest]
    return by_round(messages, keys, length).agg(*first).select(*keys, *rest)


def sketch_tables(
    messages: DataFrame, columns: list[str], length: str, width: int, levels: int | None = None,
) -> DataFrame:
    """The sketch of each window over keys made of ``columns``, as cells, when the window closes.

    Messages are counted per key first, so a key is hashed once per window; the cells of a window
    are state of fixed size. Sketches of windows add up to that of the whole stream.
    """
    counts = by_round(messages, columns, length).agg(F.count(F.lit(1)).alias("cnt"))
    weighted = counts.withColumn("key", key_text(*map(F.col, columns)))
    if levels:
        leveled = sketch.with_levels(weighted, levels)
        by, seed = ["window", "level"], F.col("level") + sketch.SEED
    else:
        leveled, by, seed = weighted, ["window"], sketch.SEED
    cells = sketch.sketch_table(leveled, width=width, seed=seed, by=by)
    return cells.withColumn("start_us", F.unix_micros("window.start")).drop("window")
