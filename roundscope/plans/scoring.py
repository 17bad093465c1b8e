"""Detectors scored against masks: the experiments behind the result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.functions.hashing import uniform
from roundscope.operators import correlate, inactivity, mask, rounds, score, sketch
from roundscope.plans import settings as S
from roundscope.plans.base import (
    ROUND, WORKER, event_buckets, event_counts, event_schedule, events, every, every_seed, keyed, named,
    round_metrics, round_start_us,
)
from roundscope.plans.correlation import sliding
from roundscope.plans.masks import sampled
from roundscope.plans.per_round import episode_activity, shifted_episodes
from roundscope.plans.sketches import estimates_by_mode
from roundscope.session import materialize
from roundscope.sources import bindings


# --- lossy worker --------------------------------------------------------------------------

def loss_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Worker counts under every (seed, loss probability), each seed with its own lossy worker.

    One draw per message and seed serves all probabilities. Workers that lost everything keep a
    row with count 0.
    """
    drawn = (
        events(spark, sf)
        .select(*WORKER, "seq", every_seed(
            lossy_worker=lambda seed: mask.seeded_worker(seed, "lossy", S.N_WORKERS)
        ))
        .withColumn("u", uniform(F.col("seq"), F.col("seed")))
    )
    kept = []
    for i, p in enumerate(S.LOSS_PROBS):
        own = F.when(F.col("worker_id") == F.col("lossy_worker"), F.lit(p)).otherwise(F.lit(0.0))
        loss = mask.compound_loss(own, F.lit(p * S.BASELINE_FRACTION))
        kept.append(score.count_if(F.col("u") >= loss).alias(f"_k{i}"))
    pairs = F.array(*[
        F.struct(F.lit(p).alias("loss_prob"), F.col(f"_k{i}").alias("cnt"))
        for i, p in enumerate(S.LOSS_PROBS)
    ])
    return (
        drawn.groupBy("seed", "lossy_worker", *WORKER)
        .agg(*kept)
        .select("seed", "lossy_worker", *WORKER, F.inline(pairs))
    )


def loss_scores(masked: DataFrame) -> DataFrame:
    """Lossy-worker scores of the exact, schedule-aware and sketch models on masked counts."""
    by = ["seed", "loss_prob"]
    masked = keyed(masked)
    table = sketch.sketch_table(masked, width=S.SKETCH_WIDTH, by=by)
    rows = sketch.point_estimates(
        masked, table, [*by, "lossy_worker", *WORKER, "cnt"], width=S.SKETCH_WIDTH, by=by,
        sketches=len(S.SEEDS) * len(S.LOSS_PROBS),
    )
    below = F.when(F.col("cnt") < S.EXPECTED_WORKER, F.col("cnt"))
    return score.lowest_worker_scores(
        rows, by, "lossy_worker", "cnt",
        {"dataflow": F.col("cnt"), "schedule_aware": below, "sketch": F.col("est")},
    )


SCORE_COLUMNS = ["system", "seed", "loss_prob", "lossy_worker", "tp", "pp", "ap",
                 "precision", "recall"]


def score_lossy_worker(spark: SparkSession, sf: str) -> DataFrame:
    return loss_scores(loss_counts(spark, sf)).filter(F.col("system") != "schedule_aware").select(
        *SCORE_COLUMNS
    )


def score_lossy_expected(spark: SparkSession, sf: str) -> DataFrame:
    return loss_scores(loss_counts(spark, sf)).filter(F.col("system") == "schedule_aware").select(
        *SCORE_COLUMNS
    )


def width_scores(masked: DataFrame) -> DataFrame:
    """Scores of the sketch per width at one loss probability, with the exact model's."""
    masked = keyed(masked.filter(F.col("loss_prob") == S.SWEEP_LOSS_PROB))
    rows = sketch.width_sweep(
        masked, [*WORKER, "lossy_worker"], list(S.SKETCH_WIDTHS), by=["seed"],
        sketches=len(S.SEEDS),
    )
    return score.lowest_worker_scores(
        rows, ["seed", "sketch_width"], "lossy_worker", "cnt",
        {"dataflow": F.col("cnt"), "sketch": F.col("est")},
        {"abs_error": F.abs(F.col("est") - F.col("cnt"))},
    )


def sketch_width_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch scores and total error per width, beside the exact model at the same loss."""
    def of(system: str, name: str) -> Column:
        return F.max(F.when(F.col("system") == system, F.col(name)))

    return (
        width_scores(loss_counts(spark, sf))
        .groupBy("seed", "sketch_width")
        .agg(
            of("sketch", "precision").alias("precision"),
            of("sketch", "recall").alias("recall"),
            of("dataflow", "precision").alias("exact_precision"),
            of("dataflow", "recall").alias("exact_recall"),
            of("sketch", "abs_error").alias("abs_error"),
        )
        .withColumn("state_entries", (F.col("sketch_width") * S.SKETCH_DEPTH).cast("bigint"))
    )


# --- sketch keys under intermittent loss ---------------------------------------------------

def score_key_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Which sketch keys still find the rounds in which one worker loses messages now and then.

    The loss is counted, not applied to the messages: one pass gives what the worker would lose
    per seed and round, and the counts of the sampled rounds are reduced by it. The finest key
    keeps chunks apart, which amounts to exact counts.
    """
    counts = event_counts(spark, sf)
    lost = (
        events(spark, sf)
        .filter(F.col("worker_id") == S.FAULT_WORKER)
        .select(*WORKER, "seq", every(S.SEEDS, "seed"))
        .withColumn("_hit", uniform(F.col("seq"), F.col("seed")) < S.INTERMITTENT_PROB)
        .groupBy("seed", *WORKER)
        .agg(F.greatest(F.lit(1), score.count_if(F.col("_hit"))).alias("lost"))
    )
    faults = sampled(counts.select(*ROUND).distinct(), S.INTERMITTENT_FRACTION)
    actual = materialize(lost.join(faults, ["seed", *ROUND], "left_semi"), "intermittent-loss")
    left = (
        counts.select("*", every(S.SEEDS, "seed"))
        .join(actual, ["seed", *WORKER], "left")
        .select("seed", *WORKER, (F.col("cnt") - F.coalesce("lost", F.lit(0))).alias("cnt"))
    )
    estimates = estimates_by_mode(left, by=["seed"]).unionByName(
        left.select(
            F.lit("job_round_worker_chunk").alias("key_mode"), F.lit(3).alias("mode_order"),
            "seed", *WORKER, "cnt", F.col("cnt").alias("est"),
        )
    )
    keys = ["key_mode", "mode_order", "seed", *ROUND]
    predicted = rounds.gap_rounds(
        estimates, S.FAULT_WORKER, S.CONTROL_GAP, by=keys, cnt="est"
    )
    modes = F.inline(F.array(*[
        F.struct(F.lit(mode).alias("key_mode"), F.lit(i).alias("mode_order"))
        for i, mode in enumerate((*S.KEY_MODES, "job_round_worker_chunk"))
    ]))
    truth = actual.select("seed", *ROUND, modes)
    flags = score.set_flags(predicted, truth, keys)
    return score.set_score(flags, ["key_mode", "mode_order", "seed"])


# --- straggler -----------------------------------------------------------------------------

def score_straggler(spark: SparkSession, sf: str) -> DataFrame:
    """Straggler scores under delays of one worker per seed.

    Truth is the delayed worker, in every round in which it sent anything. A delay moves all
    messages of a worker alike, so the last message per worker is found once
    and the delays are applied to those few rows.
    """
    tails = rounds.worker_tail(events(spark, sf).select(*WORKER, "ts_us", "seq")).select(
        *WORKER, "ts_us", (-F.col("seq")).alias("arrival")
    )
    grid = tails.select("*", every_seed(
        straggler=lambda seed: mask.seeded_worker(seed, "straggler", S.N_WORKERS)
    )).select("*", every(S.DELAYS_MS, "delay_ms"))
    own = F.col("worker_id") == F.col("straggler")
    delayed = F.col("ts_us") + F.when(own, F.col("delay_ms").cast("bigint") * 1000).otherwise(0)
    per_round = grid.groupBy("seed", "delay_ms", "straggler", *ROUND).agg(
        F.max_by("worker_id", F.struct(delayed, "arrival")).alias("last_worker"),
        F.max(own.cast("int")).alias("_present"),
    )
    hit = F.col("last_worker") == F.col("straggler")
    scored = per_round.groupBy("seed", "delay_ms", "straggler").agg(
        F.count(F.lit(1)).alias("observed_rounds"),
        score.count_if(hit).alias("tp"),
        score.count_if(hit).alias("pp"),
        score.count_if(F.col("_present") == 1).alias("ap"),
    )
    return score.with_precision_recall(scored)


# --- failed and silent rounds --------------------------------------------------------------

def fault_states(spark: SparkSession, sf: str) -> DataFrame:
    """Inactivity outcome of every scheduled round under every seed and fault type.

    Faults remove whole rounds or whole chunks, so they commute with the bucket aggregation:
    messages are read and combined once and the faults are applied to buckets.
    """
    buckets = event_buckets(spark, sf, by=[*ROUND, "chunk_id"])
    faults = sampled(buckets.select(*ROUND).distinct(), S.FAULT_FRACTION).withColumn(
        "sampled", F.lit(True)
    )
    planned = (
        event_schedule(buckets).select("*", every(S.SEEDS, "seed"))
        .join(faults, ["seed", *ROUND], "left")
        .select("*", every(S.FAULT_TYPES, "fault_type"))
    )
    faulty = F.coalesce("sampled", F.lit(False)) & (F.col("fault_type") != "healthy")
    failed = F.col("actual") & (F.col("fault_type") == "failed_round")
    silent = F.col("actual") & (F.col("fault_type") == "missing_chunks") & (F.col("chunk_id") == 1)
    states = inactivity.inactivity_states(
        buckets, planned.withColumn("actual", faulty), ["seed", "fault_type", *ROUND],
        hidden=failed | silent, carry=("actual",),
    )
    return states.withColumn("predicted", F.col("detected_us").isNotNull())


def fault_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, false-positive rate and time to detection per seed and fault type.

    The time runs from the round start and is averaged over true positives; their number is
    ``tp``, so a mean of 0.0 without detections can be told apart.
    """
    p, a = F.col("predicted"), F.col("actual")
    delay = F.when(p & a, F.col("detected_us") - F.col("start_us"))
    scored = fault_states(spark, sf).groupBy("seed", "fault_type").agg(
        score.count_if(p & a).alias("tp"),
        score.count_if(p).alias("pp"),
        score.count_if(a).alias("ap"),
        score.count_if(p & ~a).alias("fp"),
        score.count_if(~a).alias("healthy_rounds"),
        score.average_delay_ms(delay).alias("time_to_detection_ms"),
        F.max("total").alias("largest_round"),
    )
    return score.with_precision_recall(scored).withColumn(
        "false_positive_rate",
        score.false_positive_rate(F.col("fp"), F.col("healthy_rounds")),
    )


def score_sets(spark: SparkSession, sf: str) -> DataFrame:
    return fault_scores(spark, sf).select(
        "seed", "fault_type", "tp", "pp", "ap", "fp", "precision", "recall"
    )


def score_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return fault_scores(spark, sf).select(
        "seed", "fault_type", "fp", "healthy_rounds", "false_positive_rate"
    )


def score_ttd(spark: SparkSession, sf: str) -> DataFrame:
    return fault_scores(spark, sf).select(
        "seed", "fault_type", F.col("tp").alias("detections"), "time_to_detection_ms"
    )


def score_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Length as a sign of quality, scored on the labelled documents alone."""
    documents = bindings.load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = bindings.load(spark, sf, "labels").select("doc_id", "quality")
    flags = documents.join(labels, "doc_id").select(
        "lang", (F.col("n_chars") >= S.LONG_CHARS).alias("predicted"),
        (F.col("quality") == 1).alias("actual"),
    )
    return score.set_score(flags, ["lang"])


# --- interference --------------------------------------------------------------------------

def score_interference(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding correlation against activity that really delays the rounds it falls in.

    Activity is drawn within shifted episodes and adds a fixed delay to the measured latency.
    The external correlator loses some rounds and reports later; the schedule-aware one does
    neither.
    """
    metrics = round_metrics(spark, sf)
    activity = materialize(episode_activity(metrics), "episode-activity")
    systems = F.inline(F.array(
        F.struct(
            F.lit("dataflow_external_windowed").alias("system"),
            F.lit(S.EXPORT_DROP_PROB).alias("drop_prob"),
            F.lit(S.EXPORT_LATENCY_US).cast("bigint").alias("export_us"),
        ),
        F.struct(
            F.lit("schedule_aware").alias("system"), F.lit(0.0).alias("drop_prob"),
            F.lit(0).cast("bigint").alias("export_us"),
        ),
    ))
    draw = uniform(F.lit("export"), F.col("job_id"), F.col("round_id"), F.col("seed"))
    active = F.coalesce("active", F.lit(False))
    delay = F.when(F.col("active"), F.lit(S.INTERFERENCE_DELAY_US)).otherwise(F.lit(0))
    inputs = (
        metrics.select(*ROUND, "latency_us", every(S.SEEDS, "seed"))
        .join(activity, ["seed", *ROUND], "left")
        .withColumn("active", active)
        .withColumn("latency_us", F.col("latency_us") + delay)
        .withColumn("detected_us", round_start_us() + F.lit(S.DAY_US))
        .select("*", systems)
        .filter(draw >= F.col("drop_prob"))
        .drop("drop_prob")
    )
    by = ["system", "seed", "job_id"]
    found = sliding(inputs, by).filter(F.col("score") >= S.INTERFERENCE_THRESHOLD)
    alerts = materialize(
        found.select(*by, "round_id", (F.col("detected_us") + F.col("export_us"))
                     .alias("detected_us")),
        "interference-alerts",
    )
    names = F.explode(F.array(F.lit("dataflow_external_windowed"), F.lit("schedule_aware")))
    truth = activity.filter("active").select(names.alias("system"), "seed", *ROUND)
    scored = score.set_score(
        score.set_flags(alerts, truth, [*by, "round_id"]), ["system", "seed"]
    )
    first = correlate.first_detections(
        alerts, shifted_episodes(metrics), S.CORR_WINDOW, ["seed", "job_id"], by
    )
    ttd = first.groupBy("system", "seed").agg(
        F.count(F.lit(1)).alias("episodes_found"),
        score.average_delay_ms(F.col("detected_us") - round_start_us("start_round")).alias("_ttd"),
    )
    return scored.join(ttd, ["system", "seed"], "left").select(
        *scored.columns, F.coalesce("episodes_found", F.lit(0)).alias("episodes_found"),
        F.coalesce("_ttd", F.lit(0.0)).alias("time_to_detection_ms"),
    )


# --- negative controls ---------------------------------------------------------------------

def control_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds and alerts of each control and job: complete rounds, which lack no contribution.

    Counts and pairs come from one table with a row per (round, worker, chunk).
    """
    messages = events(spark, sf)
    cells = materialize(
        messages.groupBy(*WORKER, "chunk_id").agg(F.count(F.lit(1)).alias("n")), "pair-cells"
    )
    clean = (
        cells.groupBy(*ROUND).agg(F.count(F.lit(1)).alias("pairs"))
        .filter(F.col("pairs") >= S.EVENT_PAIRS).select(*ROUND)
    )
    counts = rounds.worker_counts(cells, weight="n")
    q2_clean = rounds.gap_rounds(counts, 0, S.CONTROL_GAP).join(clean, ROUND, "left_semi")
    q3_clean = rounds.tail_gap(messages, S.TAIL_GAP_US).filter("alert").join(
        clean, ROUND, "left_semi"
    )

    def marks(query: str, alerts: DataFrame) -> DataFrame:
        def mark(df: DataFrame, r: int, a: int) -> DataFrame:
            return df.select(
                F.lit(query).alias("query"), F.lit("complete_rounds").alias("control_type"),
                "job_id", F.lit(r).alias("r"), F.lit(a).alias("a"),
            )

        return mark(clean, 1, 0).unionByName(mark(alerts, 0, 1))

    return marks("Q2", q2_clean).unionByName(marks("Q3", q3_clean))


def control_rates(marks: DataFrame, by: list[str]) -> DataFrame:
    sums = marks.groupBy(*by).agg(
        F.sum("r").alias("rounds"), F.sum("a").cast("bigint").alias("alerts")
    )
    return sums.withColumn(
        "false_positive_rate", score.false_positive_rate(F.col("alerts"), F.col("rounds"))
    )


def negative_controls(spark: SparkSession, sf: str) -> DataFrame:
    """False-positive rate of each control and job, a row for each that has complete rounds."""
    control = F.concat_ws(" ", "query", "control_type")
    rates = control_rates(
        control_marks(spark, sf).withColumn("control", control), ["control", "job_id"]
    )
    return rates.select("control", "job_id", "false_positive_rate")


QUERIES = named(
    score_lossy_worker, score_lossy_expected, sketch_width_sweep, score_key_modes,
    score_straggler, score_sets, score_fpr, score_ttd, score_labels, score_interference,
    negative_controls,
)
