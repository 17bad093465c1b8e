"""State-size arithmetic: entries, bits, bytes and operations of each query model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundscope.functions.numeric import bytes_of_bits, ceil_log2

# Bit widths and per-message operations that the sizes are computed from.
COUNTER_BITS = 32
TIMESTAMP_BITS = 64
SKETCH_DEPTH = 5
WINDOW_SIZE = 8


def _case(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def state_cost(rows: DataFrame) -> DataFrame:
    """Add ``counter_bits, register_bytes, keys_tracked, per_packet_ops, scaling_model``.

    ``rows`` has ``workload, query, system, expressible, key_mode, window_size, n_jobs,
    n_rounds, n_workers, n_chunks, state_entries``. Rows that a model cannot express carry no
    size; rows without state carry none either.
    """
    state = F.col("state_entries").cast("bigint")
    workers = F.coalesce("n_workers", F.lit(0)).cast("bigint")
    chunks = F.coalesce("n_chunks", F.lit(0)).cast("bigint")
    round_keys = F.coalesce("n_jobs", F.lit(1)) * F.coalesce("n_rounds", F.lit(0)) * workers
    window = F.coalesce("window_size", F.lit(WINDOW_SIZE)).cast("bigint")
    mode, query = F.col("key_mode"), F.col("query")
    aware, sketch = F.col("system") == "schedule_aware", F.col("system") == "sketch"
    external = F.col("system") == "dataflow_external_windowed"
    argmax_bits = F.lit(TIMESTAMP_BITS) + ceil_log2(F.greatest(F.lit(1), workers))
    window_bits = window * TIMESTAMP_BITS + window

    bits = _case(
        [
            (aware & (query == "Q2"), state * COUNTER_BITS),
            (aware & (query == "Q3"), argmax_bits.cast("bigint")),
            (aware & (query == "Q4"), workers * COUNTER_BITS + chunks),
            (aware & (query == "Q5"), window_bits),
            (sketch, state * COUNTER_BITS),
            (query == "Q3", state * argmax_bits),
            (query == "Q4", state),
            ((query == "Q5") & external, window_bits),
        ],
        state * COUNTER_BITS,
    )
    keys = _case(
        [
            (aware & (query == "Q3"), F.lit(1)),
            ((query == "Q5") & (aware | external), window),
            (sketch & (mode == "worker"), workers),
            (sketch & (mode == "job_worker"), F.coalesce("n_jobs", F.lit(1)) * workers),
            (sketch & (mode == "job_round_worker_chunk"), round_keys * chunks),
            (sketch, round_keys),
        ],
        state,
    )
    ops = _case(
        [
            (sketch, F.lit(SKETCH_DEPTH)),
            (query.isin("Q3", "Q4") | ((query == "Q5") & (aware | external)), F.lit(2)),
        ],
        F.lit(1),
    )
    # Names of how state grows.
    scaling = _case(
        [
            (aware & (query == "Q2"), F.lit("active-round worker counters + round metadata")),
            (aware & (query == "Q3"), F.lit("active-round timestamp+argmax worker")),
            (aware & (query == "Q4"), F.lit("active-round worker counters + chunk bitmap")),
            (aware & (query == "Q5"), F.lit("job-round correlation window")),
            (sketch & (mode == "worker"), F.lit("workers")),
            (sketch & (mode == "job_worker"), F.lit("jobs*workers")),
            (sketch & (mode == "job_round_worker"), F.lit("jobs*rounds*workers")),
            (sketch & (mode == "job_round_worker_chunk"), F.lit("jobs*rounds*workers*chunks")),
            (sketch, F.lit("fixed sketch registers; logical keys jobs*rounds*workers")),
            ((query == "Q2") & (F.col("workload") == "multitenant"), F.lit("jobs*rounds*workers")),
            (query == "Q2", F.lit("rounds*workers")),
            (query == "Q3", F.lit("rounds with timestamp+argmax worker")),
            (query == "Q4", F.lit("workers*chunks expected-set bitmap")),
            ((query == "Q5") & external, F.lit("window_size downstream correlation state")),
        ],
        F.lit("state_entries"),
    )
    sized = F.col("expressible") & state.isNotNull()
    return (
        rows.withColumn("counter_bits", F.when(sized, bits.cast("bigint")))
        .withColumn("register_bytes", bytes_of_bits(F.col("counter_bits")))
        .withColumn("keys_tracked", F.when(sized, keys.cast("bigint")))
        .withColumn("per_packet_ops", F.when(sized, ops.cast("bigint")))
        .withColumn(
            "scaling_model",
            F.when(~F.col("expressible"), F.lit("not expressible")).when(sized, scaling),
        )
    )


def modelled_messages() -> Column:
    """Messages of a complete run: workers x chunks x rounds x jobs."""
    return (
        F.col("n_workers").cast("bigint") * F.col("n_chunks") * F.col("n_rounds") * F.col("n_jobs")
    )
