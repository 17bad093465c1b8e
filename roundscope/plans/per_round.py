"""Scans, projections, per-round questions and the expected schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.functions.hashing import key_text, uniform
from roundscope.functions.numeric import is_false, numeric_or_null
from roundscope.operators import inactivity, mask, rounds, score
from roundscope.operators.schedule import episodes, in_episode
from roundscope.plans import settings as S
from roundscope.plans.base import (
    ROUND, WORKER, event_buckets, event_schedule, events, every, every_seed, lines, named,
    observed_rounds,
)
from roundscope.session import materialize, work_path
from roundscope.sources import bindings, results


# --- scans and sinks -----------------------------------------------------------------------

def scan_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf)


def results_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two result tables with different columns, appended, written as CSV and read back."""
    latency = rounds.round_latency(events(spark, sf)).select(
        F.lit("Q1").alias("query"), *ROUND, "latency_us"
    )
    low = q2_lossy_worker(spark, sf).select(F.lit("Q2").alias("query"), "*")
    rows = results.append_rows([latency, low])
    path = work_path(spark, "results-csv")
    results.write_csv(rows, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return results.read_csv(spark, path, schema)


def merge_ordered(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["ts_us", *WORKER, "chunk_id", "seq"]
    return rounds.merge_ordered(
        [events(spark, sf).select(*columns), lines(spark, sf).select(*columns)]
    )


def q2_from_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Worker counts from a stored, already compressed table (one row per chunk)."""
    compressed = lines(spark, sf).groupBy(*WORKER, "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return rounds.worker_counts(materialize(compressed, "compressed-counts"), weight="n")


def round_tail(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.worker_tail(events(spark, sf))


# --- projections and filters ---------------------------------------------------------------

def flt_events(spark: SparkSession, sf: str) -> DataFrame:
    stored = bindings.load(spark, sf, "events")
    return bindings.event_messages(
        stored.filter((F.col("value") > 20.0) & F.col("event_type").isin("click", "view")),
        stored,
    )


def map_events(spark: SparkSession, sf: str) -> DataFrame:
    """Key and value of every message."""
    return events(spark, sf).select(
        key_text(F.col("job_id"), F.col("round_id")).alias("key"),
        F.col("ts_us").alias("value"),
    )


def round_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return event_schedule(events(spark, sf)).drop("timeout_us")


def shifted_episodes(observed: DataFrame) -> DataFrame:
    """Activity episodes of each job, their boundaries shifted by up to two rounds per seed."""
    jobs = bindings.event_jobs(observed)
    shift = F.col("shift")
    return (
        episodes(jobs)
        .join(jobs.select("job_id", "n_rounds"), "job_id")
        .select("*", every_seed(shift=lambda seed: mask.seeded_worker(seed, "shift", 5) - 2))
        .select(
            "job_id",
            "seed",
            F.greatest(F.lit(0), F.col("start_round") + shift).alias("start_round"),
            F.least(F.col("n_rounds"), F.col("end_round") + shift).alias("end_round"),
        )
    )


def episode_activity(observed: DataFrame) -> DataFrame:
    """Observed rounds inside an episode of their seed, with a drawn activity flag."""
    per_seed = observed.select(*ROUND, every(S.SEEDS, "seed"))
    draw = uniform(F.lit("active"), F.col("job_id"), F.col("round_id"), F.col("seed"))
    return in_episode(per_seed, shifted_episodes(observed), ["job_id", "seed"]).select(
        "seed", *ROUND, (draw < S.EPISODE_ACTIVE_PROB).alias("active")
    )


def rounds_in_episode(spark: SparkSession, sf: str) -> DataFrame:
    return episode_activity(observed_rounds(spark, sf))


def safe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Text that may or may not be a number, and text that may or may not mean false."""
    digits = F.regexp_replace("props", "[^0-9]", "")
    text = (
        F.when(F.col("event_type") == "error", F.lit(""))
        .when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("-"), digits, F.lit(".5e1")))
        .when(F.col("event_type") == "purchase", F.concat(digits, F.lit("d")))
        .otherwise(digits)
    )
    flag = (
        F.when(F.col("user_id") % 3 == 0, F.lit("False"))
        .when(F.col("user_id") % 3 == 1, F.lit("FALSE "))
        .otherwise(F.col("user_id").cast("string"))
    )
    return bindings.load(spark, sf, "events").select(
        "event_id", numeric_or_null(text).alias("num"), is_false(flag).alias("is_false")
    )


# --- per-round questions -------------------------------------------------------------------

def q1_round_latency(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.round_latency(events(spark, sf))


def q2_worker_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.worker_counts(lines(spark, sf))


def q2_lossy_worker(spark: SparkSession, sf: str) -> DataFrame:
    """Silent workers count as well; a worker falls short of what its job's workers usually send."""
    counts = materialize(
        rounds.complete_counts(rounds.worker_counts(events(spark, sf)), S.N_WORKERS), "all-counts"
    )
    jobs = rounds.usual(counts, "cnt").withColumnRenamed("usual", "expected_chunks")
    return rounds.lossy_worker(counts, jobs)


def q2_gap_rounds(spark: SparkSession, sf: str) -> DataFrame:
    counts = rounds.complete_counts(rounds.worker_counts(lines(spark, sf)), S.N_LINE_WORKERS)
    return rounds.gap_rounds(counts, worker=7, min_gap=2)


def q3_straggler(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.straggler(events(spark, sf))


def q3_tail_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.tail_gap(events(spark, sf), S.TAIL_GAP_US)


def q4_incomplete_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness of both bindings; only observed rounds appear."""
    of_events = rounds.incomplete_rounds(events(spark, sf), S.EVENT_PAIRS)
    of_lines = rounds.incomplete_rounds(lines(spark, sf), S.LINE_PAIRS)
    return of_events.withColumn("source", F.lit("events")).unionByName(
        of_lines.withColumn("source", F.lit("lineitem"))
    )


def q4_conversation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose turns do not run from 0 to the last one without a hole."""
    turns = bindings.conversation_messages(bindings.load(spark, sf, "conversations"))
    return (
        turns.groupBy("round_id", "chunk_id").agg(F.lit(1).alias("_one"))
        .groupBy("round_id")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            (F.max("chunk_id") + 1).alias("expected"),
        )
        .withColumn("incomplete", F.col("turns") < F.col("expected"))
    )


def distinct_first(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.distinct_first(events(spark, sf), [*WORKER, "chunk_id"])


def reduce_by_key_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Caller-supplied fold for first and last time per round; equals the built-in aggregate."""
    both = F.struct(F.col("ts_us").alias("lo"), F.col("ts_us").alias("hi"))
    return rounds.fold_by_key(
        events(spark, sf), ROUND, "seq", both,
        merge=lambda a, b: F.struct(
            F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")
        ),
        finish=lambda acc: acc["hi"] - acc["lo"],
    ).withColumnRenamed("value", "latency_us")


def reduce_by_key_named(spark: SparkSession, sf: str) -> DataFrame:
    """Every named reducer over the chunks of a round's messages."""
    reduced = rounds.reduce_by_key_all(events(spark, sf), ROUND, "chunk_id")
    return reduced.select(
        *ROUND, F.col("sum.value").alias("total"), F.col("count.value").alias("n"),
        F.col("min_max.lo").alias("lo"), F.col("min_max.hi").alias("hi"),
        F.col("arg_max.value").alias("last_worker"),
        F.array_join(F.col("set_union.value").cast("array<string>"), ",").alias("chunks"),
    )


def fold_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """A fold whose merge may not be turned around: workers in order of arrival, as digits.

    An accumulator is the step ``x -> m * x + a`` that its messages make together.
    """
    base, prime = F.lit(S.FOLD_BASE), F.lit(S.FOLD_PRIME)
    step = F.struct(base.cast("bigint").alias("m"), F.col("worker_id").cast("bigint").alias("a"))
    return rounds.fold_by_key(
        events(spark, sf), ROUND, "seq", step,
        merge=lambda x, y: F.struct(
            (x["m"] * y["m"] % prime).alias("m"), ((x["a"] * y["m"] + y["a"]) % prime).alias("a")
        ),
        finish=lambda acc: (acc["m"] + acc["a"]) % prime,
    ).withColumnRenamed("value", "digest")


# --- expected schedule ---------------------------------------------------------------------

def q4_failures_from_counts(spark: SparkSession, sf: str) -> DataFrame:
    totals = materialize(
        events(spark, sf).groupBy(*ROUND).agg(F.count(F.lit(1)).alias("observed")),
        "round-totals",
    )
    return inactivity.deadline_alerts(totals, event_schedule(totals))


def q4_inactivity_alerts(spark: SparkSession, sf: str) -> DataFrame:
    buckets = event_buckets(spark, sf)
    return inactivity.inactivity_alerts(buckets, event_schedule(buckets))


def q4_inactivity_default_time(spark: SparkSession, sf: str) -> DataFrame:
    """As above, with the afternoon messages of odd workers arriving without a time."""
    untimed = (F.col("chunk_id") == 1) & (F.col("worker_id") % 2 == 1)
    messages = events(spark, sf).withColumn("ts_us", F.when(~untimed, F.col("ts_us")))
    buckets = materialize(
        inactivity.activity_buckets(messages, S.TIMEOUT_US), "activity-buckets"
    )
    return inactivity.inactivity_alerts(buckets, event_schedule(buckets))


def timeout_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Detection lag of short rounds against false alarms on complete ones, per timeout."""
    buckets = event_buckets(spark, sf, min(S.SWEEP_TIMEOUTS_US))
    grid = event_schedule(buckets).drop("timeout_us").select(
        "*", every(S.SWEEP_TIMEOUTS_US, "timeout_us")
    )
    states = inactivity.inactivity_states(buckets, grid, [*ROUND, "timeout_us"])
    fired, short = F.col("detected_us").isNotNull(), F.col("total") < F.col("expected")
    lag = F.when(fired & short, F.col("detected_us") - F.col("start_us"))
    return (
        states.groupBy("timeout_us")
        .agg(
            score.count_if(fired).alias("alerts"),
            *[
                score.count_if(F.coalesce(F.col("reason") == name, F.lit(False))).alias(
                    name.replace("-", "_")
                )
                for name in ("missing-round", "premature-timeout", "missing-pairs")
            ],
            score.count_if(~short).alias("healthy_rounds"),
            score.count_if(fired & ~short).alias("false_positives"),
            score.average_delay_ms(lag).alias("lag_ms"),
        )
        .withColumn(
            "false_positive_rate",
            score.false_positive_rate(F.col("false_positives"), F.col("healthy_rounds")),
        )
    )


QUERIES = named(
    scan_events, results_csv_roundtrip, merge_ordered, q2_from_counts, round_tail, flt_events,
    map_events, round_schedule, rounds_in_episode, safe_numeric, q1_round_latency,
    q2_worker_counts, q2_lossy_worker, q2_gap_rounds, q3_straggler, q3_tail_gap,
    q4_incomplete_rounds, q4_conversation_gaps, distinct_first, reduce_by_key_fold,
    reduce_by_key_named, fold_in_order,
    q4_failures_from_counts, q4_inactivity_alerts, q4_inactivity_default_time, timeout_sweep,
)
