"""Streaming queries: replay stored events through a streaming plan and return the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundscope.functions.numeric import half_even
from roundscope.operators import correlate, sketch
from roundscope.operators.schedule import episodes, schedule
from roundscope.plans import settings as S
from roundscope.plans.base import (
    PAIR, ROUND, WORKER, event_counts, keyed, named, round_metrics, round_start_us, usual_counts,
)
from roundscope.plans.correlation import alerts
from roundscope.plans.sketches import KEY_COLUMNS
from roundscope.session import materialize
from roundscope.sources import bindings
from roundscope.streaming import monitors, stateful
from roundscope.streaming.replay import Replay, end_row, ordered_feed

#: Length of a round of the event binding.
LENGTH = "1 day"
#: Parts in which a stored table is fed to a stream.
FEED_PARTS = 3


def replay_events(
    spark: SparkSession, sf: str, max_files: int | None = None
) -> tuple[Replay, DataFrame]:
    """The events table as a stream of messages with an event time, in several micro-batches.

    The table is fed in time order; with ``max_files`` its own files are, as many at a time.
    """
    stored = bindings.load(spark, sf, "events")
    ended = not max_files
    if max_files:
        # A pattern that matches one name: the table may be a single file, which a plain stream
        # path may not be.
        path = f"{sf}/{{events}}.parquet"
    else:
        path, max_files = ordered_feed(stored, "ts", FEED_PARTS)
    replay = Replay(spark, path, stored.schema, max_files, ended)
    messages = bindings.event_messages(replay.rows, stored)
    return replay, messages.withColumn("ts", F.timestamp_micros("ts_us"))


def configured_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The job dimension: a row per ranked name, with the rounds that are planned for each."""
    names = bindings.ranked_names(bindings.load(spark, sf, "events"), "event_type")
    planned = names.table.select(
        F.col("number").alias("job_id"), F.lit(S.N_ROUNDS - 1).alias("round_id")
    )
    return bindings.event_jobs(planned)


def planned_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Schedule of the configured jobs; no message is read for it."""
    return schedule(configured_jobs(spark, sf), S.TIMEOUT_US, F.lit(S.EXPECTED_ROUND))


def stream_scan_events(spark: SparkSession, sf: str) -> DataFrame:
    replay, messages = replay_events(spark, sf)
    return replay.to_table(messages.filter(F.col("seq").isNotNull()).drop("ts"))


def stream_q1_latency(spark: SparkSession, sf: str) -> DataFrame:
    replay, messages = replay_events(spark, sf)
    return replay.to_table(monitors.round_latency(messages, LENGTH))


def stream_q2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts in update mode: each batch writes its changed keys, the last one counts.

    The fold's state lives in the checkpoint, so it continues over restarts of the query.
    """
    replay, messages = replay_events(spark, sf)
    changes = f"{replay.root}/changes"
    plan = monitors.worker_counts(messages, LENGTH)

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")

    replay.for_each_batch(plan, write, "update")
    log = spark.read.schema(plan.schema.add("batch_id", T.LongType())).parquet(changes)
    latest = log.groupBy(*WORKER).agg(F.max_by("cnt", "batch_id").alias("cnt"))
    return latest.filter(F.col("worker_id").isNotNull())


def stream_q3_straggler(spark: SparkSession, sf: str) -> DataFrame:
    replay, messages = replay_events(spark, sf)
    return replay.to_table(monitors.straggler(messages, LENGTH))


def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    replay, messages = replay_events(spark, sf)
    return replay.to_table(monitors.distinct_first(messages, WORKER, LENGTH))


def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    replay, messages = replay_events(spark, sf)
    return replay.to_table(monitors.tumbling_counts(messages, LENGTH))


def stream_inactivity_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds that stall or never come, noticed by timers that the schedule arms."""
    replay, messages = replay_events(spark, sf)
    plan = materialize(planned_rounds(spark, sf), "planned-rounds")
    told = replay.to_table(stateful.monitor_rounds(messages, on(replay, plan), S.TIMEOUT_US))
    return told.filter("kind = 'alert'").select(
        *ROUND, "detected_us", "observed", "expected", "reason"
    )


def stream_sketch_table(spark: SparkSession, sf: str) -> DataFrame:
    """One sketch per day, merged afterwards."""
    replay, messages = replay_events(spark, sf)
    daily = replay.to_table(monitors.sketch_tables(messages, WORKER, LENGTH, S.SKETCH_WIDTH))
    return sketch.merge_tables(daily)


def stream_sketch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates read from merged daily sketches."""
    counts = keyed(event_counts(spark, sf))
    cells = materialize(stream_sketch_table(spark, sf), "sketch-cells")
    return sketch.point_estimates(counts, cells, [*WORKER, "cnt"], width=S.SKETCH_WIDTH)


def stream_sketch_levels(spark: SparkSession, sf: str) -> DataFrame:
    replay, messages = replay_events(spark, sf)
    daily = replay.to_table(monitors.sketch_tables(
        messages, KEY_COLUMNS["job_worker"], LENGTH, S.SKETCH_WIDTH, S.SKETCH_LEVELS
    ))
    return sketch.merge_tables(daily, ["level"])


def stream_state_entries(spark: SparkSession, sf: str) -> DataFrame:
    """State measured in the checkpoints of streams that have taken in everything.

    Exact counts without a horizon keep every key, closed rounds keep none, and a sketch that is
    never closed keeps its cells; ``state_totals`` has what the models say.
    """
    found = None
    for model in ("dataflow", "dataflow_windowed", "sketch"):
        replay, messages = replay_events(spark, sf)
        real = messages.filter("seq is not null")
        if model == "dataflow":
            plan = real.groupBy(*WORKER).agg(F.count(F.lit(1)).alias("cnt"))
        elif model == "dataflow_windowed":
            plan = monitors.worker_counts(messages, LENGTH)
        else:
            # One row per message: its key is hashed as it comes.
            single = keyed(real.select(*WORKER, F.lit(1).alias("cnt")))
            plan = sketch.sketch_table(single, width=S.SKETCH_WIDTH)
        replay.for_each_batch(plan, lambda rows, batch_id: rows.write.format("noop").mode(
            "overwrite").save(), "update")
        held = replay.state()
        if model == "dataflow_windowed":
            # But for the row that ended the replay.
            held = held.filter("key.worker_id is not null")
        entries = held.agg(F.count(F.lit(1)).alias("entries"))
        one = materialize(entries.select(F.lit(model).alias("system"), "entries"), "state-entries")
        found = one if found is None else found.unionByName(one)
    return found


def shifted_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The configured jobs on another schedule: each starts later than the one before it, and its
    rounds have gaps between them."""
    return configured_jobs(spark, sf).select(
        "job_id", "n_workers", "n_chunks", F.lit(S.GAP_ROUNDS).alias("n_rounds"),
        (F.col("start_offset_us") + F.col("job_id") * F.lit(S.HOUR_US)).alias("start_offset_us"),
        F.lit(S.GAP_DURATION_US).alias("round_duration_us"),
        F.lit(S.GAP_US).alias("inter_round_gap_us"),
    )


def stream_scheduled_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of rounds with offsets and gaps, each emitted when it is over, the absent ones too."""
    replay, messages = replay_events(spark, sf)
    jobs = materialize(shifted_jobs(spark, sf), "jobs")
    plan = materialize(schedule(jobs), "planned-rounds")
    placed = stateful.scheduled(messages, on(replay, jobs))
    told = replay.to_table(stateful.monitor_rounds(placed, on(replay, plan), S.TIMEOUT_US))
    return told.filter("kind = 'round'").select(*ROUND, "first_us", "last_us", "n")


def stream_deadline_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds below their total at the deadline; the outer join itself emits the absent ones."""
    replay, messages = replay_events(spark, sf)
    ahead = planned_rounds(spark, sf).select(
        *ROUND, F.timestamp_micros("start_us").alias("ts"), "deadline_us", "expected"
    )
    # The plan is known ahead of time; one row at its end leaves the watermark to the messages. It
    # expects nothing, so it is no alert (and no null, which the scan would drop).
    last = end_row(spark, ahead.schema).fillna(0, ["expected"])
    planned = replay.side_stream(ahead.unionByName(last), "planned")
    return replay.to_table(stateful.deadline_alerts(messages, planned, LENGTH))


def on(replay: Replay, table: DataFrame) -> DataFrame:
    """A stored table in the session of a stream."""
    return replay.session.read.schema(table.schema).parquet(*table.inputFiles())


def directed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of different jobs, in both directions, as the configured ones."""
    n = configured_jobs(spark, sf).count()
    job_a, job_b = bindings.whole(F.col("id"), max(n, 1)), F.col("id") % max(n, 1)
    return spark.range(n * n).select(
        job_a.cast("int").alias("job_a"), job_b.cast("int").alias("job_b")
    ).filter("job_a != job_b")


def correlated(
    spark: SparkSession, sf: str, pairs: DataFrame, max_files: int | None = None
) -> DataFrame:
    """Alerts of the given directed pairs, scored round by round in a ring per pair."""
    replay, messages = replay_events(spark, sf, max_files)
    usual = usual_counts(round_metrics(spark, sf))
    scores = replay.to_table(stateful.sliding_scores(
        monitors.round_metrics(messages, LENGTH), on(replay, usual),
        on(replay, materialize(pairs, "pairs")), S.CORR_WINDOW, S.RETIRE_US, S.DAY_US,
        S.EVENT_START_US,
    )).withColumn("score", half_even(F.col("score"), 6)).withColumn(
        "detected_us", round_start_us() + F.lit(S.DAY_US)
    )
    return correlate.correlation_alerts(scores, S.CORR_THRESHOLD, S.EXPORT_LATENCY_US).select(
        *PAIR, "round_id", "detected_us", "score"
    )


def stream_corr_alerts(
    spark: SparkSession, sf: str, max_files: int | None = None
) -> DataFrame:
    """What a job usually sends is known beforehand, from the stored table."""
    return correlated(spark, sf, directed_pairs(spark, sf), max_files)


def stream_configured_pair(spark: SparkSession, sf: str) -> DataFrame:
    """One configured pair: the latency of one job against the activity of another."""
    victim, other = S.CONFIGURED_PAIR
    pair = spark.range(1).select(F.lit(victim).alias("job_a"), F.lit(other).alias("job_b"))
    return correlated(spark, sf, pair)


def stream_episode_detection(spark: SparkSession, sf: str) -> DataFrame:
    """First alert of each pair in each episode of its victim, from a join of two streams."""
    metrics = round_metrics(spark, sf)
    stored = alerts(metrics).select(
        *PAIR, "round_id", "detected_us", F.timestamp_micros(round_start_us()).alias("ts")
    )
    path, files = ordered_feed(materialize(stored, "alerts"), "ts", FEED_PARTS)
    replay = Replay(spark, path, spark.read.parquet(path).schema, files, ended=True)
    jobs = configured_jobs(spark, sf)
    intervals = episodes(jobs).select(
        F.col("job_id").alias("job_a"), "start_round", "end_round",
        F.timestamp_micros(round_start_us("start_round")).alias("start"),
        F.timestamp_micros(round_start_us("end_round")).alias("end"),
    )
    ahead = intervals.unionByName(end_row(spark, intervals.schema, "start"))
    hits = replay.to_table(stateful.alerts_in_episodes(
        replay.rows, replay.side_stream(ahead, "episodes"),
        f"{S.CORR_WINDOW} days", f"{S.N_ROUNDS} days",
    ))
    first = F.min(F.struct("detected_us", "round_id")).alias("_first")
    return hits.groupBy(*PAIR, "start_round", "end_round").agg(
        first, F.count(F.lit(1)).alias("detections")
    ).select(
        *PAIR, "start_round", "end_round", "detections",
        F.col("_first.round_id").alias("alert_round"), F.col("_first.detected_us"),
        ((F.col("_first.detected_us") - round_start_us("start_round")) / 1000.0).alias("ttd_ms"),
    )


QUERIES = named(
    stream_scan_events, stream_distinct, stream_inactivity_alerts, stream_deadline_alerts,
    stream_scheduled_rounds, stream_sketch_table, stream_sketch_estimate, stream_sketch_levels,
    stream_state_entries, stream_corr_alerts, stream_configured_pair, stream_episode_detection, stream_q1_latency,
    stream_q2_counts, stream_tumbling_counts, stream_q3_straggler,
)
