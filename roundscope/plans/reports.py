"""State sizes, the complete result rows, their summary and the series drawn from them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.operators import profile, rounds, summary
from roundscope.plans import scoring
from roundscope.plans import settings as S
from roundscope.plans.base import ROUND, WORKER, events, every, named
from roundscope.session import materialize, work_path
from roundscope.sources import results

CELLS = S.SKETCH_WIDTH * S.SKETCH_DEPTH
NO_ARGMAX = "a sketch keeps no argmax over keys"
NO_EXPECTED_SET = "a sketch cannot be compared with an expected set"
NO_CORRELATION = "correlation across jobs is outside the model"


# --- state ---------------------------------------------------------------------------------

def profile_rows(spark: SparkSession, sf: str) -> DataFrame:
    """State of each query model: observed keys for exact models, arithmetic for the others."""
    pairs = events(spark, sf).groupBy(*WORKER, "chunk_id").agg(F.lit(1).alias("_one"))
    per_worker = pairs.groupBy(*WORKER).agg(F.count(F.lit(1)).alias("pairs"))
    per_round = per_worker.groupBy(*ROUND).agg(
        F.count(F.lit(1)).alias("workers"), F.sum("pairs").alias("pairs")
    )
    per_job = per_round.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("rounds"), F.sum("workers").alias("worker_keys"),
        F.sum("pairs").alias("pair_keys"),
        F.lit(S.N_WORKERS).alias("n_workers"), F.lit(S.N_CHUNKS).alias("n_chunks"),
    )
    # The schedule-aware models hold one round at a time: their size is the largest job's.
    measured = per_job.agg(
        F.count(F.lit(1)).cast("int").alias("n_jobs"),
        F.max("rounds").cast("int").alias("n_rounds"),
        F.max("n_workers").alias("n_workers"),
        F.max("n_chunks").alias("n_chunks"),
        F.sum("rounds").alias("round_keys"),
        F.sum("worker_keys").alias("worker_keys"),
        F.sum("pair_keys").alias("pair_keys"),
        F.max(F.col("n_workers") * F.col("n_chunks")).alias("largest_pairs"),
        F.max(F.col("n_workers") + 1).alias("largest_q2"),
        F.max(F.col("n_workers") + F.col("n_chunks")).alias("largest_q4"),
    )
    cells = F.lit(CELLS)
    none = F.lit(None)

    def model(query: str, system: str, state: Column, key_mode: str | None = None,
              expressible: bool = True, window: bool = False) -> Column:
        return F.struct(
            F.lit("profile").alias("workload"), F.lit(query).alias("query"),
            F.lit(system).alias("system"), F.lit(expressible).alias("expressible"),
            F.lit(key_mode).cast("string").alias("key_mode"),
            (F.lit(S.CORR_WINDOW) if window else none).cast("int").alias("window_size"),
            state.cast("bigint").alias("state_entries"),
        )

    models = F.array(
        model("Q1", "dataflow", F.col("round_keys")),
        model("Q2", "dataflow", F.col("worker_keys")),
        model("Q2", "schedule_aware", F.col("largest_q2")),
        *[model("Q2", "sketch", cells, mode) for mode in (*S.KEY_MODES, "job_round_worker_chunk")],
        model("Q2", "sketch", cells * S.SKETCH_LEVELS, "levels"),
        model("Q3", "dataflow", F.col("round_keys")),
        model("Q3", "schedule_aware", F.lit(1)),
        model("Q3", "sketch", none, expressible=False),
        model("Q4", "dataflow", F.col("round_keys")),
        model("Q4", "dataflow_pairs", F.col("pair_keys")),
        model("Q4", "dataflow_windowed", F.greatest("largest_pairs", F.lit(S.EXPECTED_ROUND))),
        model("Q4", "schedule_aware", F.col("largest_q4")),
        model("Q5", "dataflow_external_windowed", F.lit(2 * S.CORR_WINDOW), window=True),
        model("Q5", "schedule_aware", F.lit(2 * S.CORR_WINDOW), window=True),
    )
    rows = measured.select("n_jobs", "n_rounds", "n_workers", "n_chunks", F.inline(models))
    return profile.state_cost(rows).withColumn("packets", profile.modelled_messages())


def state_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile_rows(spark, sf).drop("expressible", "workload")


def state_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Total state of each model over its queries."""
    return profile_rows(spark, sf).groupBy("system").agg(
        F.count("state_entries").alias("models"),
        F.sum("state_entries").cast("bigint").alias("state_entries"),
        F.sum("register_bytes").cast("bigint").alias("register_bytes"),
    )


def job_count_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Exact state grows with the number of jobs, sketch state does not; the last row has all jobs."""
    keys = rounds.worker_counts(events(spark, sf)).filter("job_id >= 0").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("keys")
    )
    present = F.count(F.lit(1)).cast("int").alias("n_jobs"), F.sum("keys").alias("keys")
    within = keys.select("*", every(S.JOB_COUNTS, "first_jobs")).filter("job_id < first_jobs")
    sizes = within.groupBy("first_jobs").agg(*present).drop("first_jobs").unionByName(
        keys.agg(*present).filter("n_jobs > 0")
    ).groupBy("n_jobs").agg(F.max("keys").alias("keys"))
    models = F.array(
        F.struct(F.lit("dataflow").alias("system"), F.col("keys").alias("state_entries")),
        F.struct(
            F.lit("sketch").alias("system"), F.lit(CELLS).cast("bigint").alias("state_entries")
        ),
    )
    return experiment(
        sizes.select("n_jobs", F.inline(models)), "multitenant", "Q2", n_jobs="n_jobs"
    )


def state_by_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return profile.state_cost(job_count_rows(spark, sf)).select(
        "system", "n_jobs", "state_entries", "counter_bits", "register_bytes", "keys_tracked",
        "per_packet_ops", "scaling_model",
    )


# --- result rows ---------------------------------------------------------------------------

def experiment(
    rows: DataFrame, workload: str, query: str, n_jobs: str | int = S.N_JOBS
) -> DataFrame:
    """Add the configuration fields that the state arithmetic reads."""
    defaults = {
        "workload": F.lit(workload),
        "query": F.lit(query),
        "expressible": F.lit(True),
        "n_jobs": F.col(n_jobs) if isinstance(n_jobs, str) else F.lit(n_jobs),
        "n_rounds": F.lit(S.N_ROUNDS),
        "n_workers": F.lit(S.N_WORKERS),
        "n_chunks": F.lit(S.N_CHUNKS),
        "key_mode": F.lit(None).cast("string"),
        "window_size": F.lit(None).cast("int"),
        "seed": F.lit(0),
    }
    missing = {k: v for k, v in defaults.items() if k not in rows.columns or k == "n_jobs"}
    return rows.withColumns(missing)


def systems(rows: DataFrame, metrics: list[str], models: list[tuple]) -> DataFrame:
    """A row per model; ``(system, state, reason)`` with a reason leaves the metrics null."""
    def struct(system: str, state: Column, reason: str | None) -> Column:
        shown = [
            (F.col(m) if reason is None else F.lit(None)).cast("double").alias(m) for m in metrics
        ]
        return F.struct(
            F.lit(system).alias("system"), F.lit(reason is None).alias("expressible"), *shown,
            state.cast("bigint").alias("state_entries"),
            F.lit(reason).cast("string").alias("reason"),
        )

    rest = [c for c in rows.columns if c not in metrics]
    return rows.select(*rest, F.inline(F.array(*[struct(*m) for m in models])))


def packet_loss_rows(masked: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("system") == "dataflow", F.col("keys"))
        .when(F.col("system") == "schedule_aware", F.lit(S.N_WORKERS + 1))
        .otherwise(F.lit(CELLS))
    )
    scored = scoring.loss_scores(masked).withColumn("state_entries", state.cast("bigint"))
    return experiment(scored, "packet_loss", "Q2")


def budget_rows(masked: DataFrame) -> DataFrame:
    """One row per width for the sketch, and one without a width for the exact model."""
    sketched = F.col("system") == "sketch"
    state = F.when(sketched, F.col("sketch_width") * S.SKETCH_DEPTH).otherwise(F.col("keys"))
    scored = (
        scoring.width_scores(masked)
        .filter(sketched | (F.col("sketch_width") == min(S.SKETCH_WIDTHS)))
        .withColumn("state_entries", state.cast("bigint"))
        .withColumn("sketch_width", F.when(sketched, F.col("sketch_width")))
        .withColumn("loss_prob", F.lit(S.SWEEP_LOSS_PROB))
    )
    return experiment(scored, "sketch_budget", "Q2")


def loss_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Both experiments on masked counts; the messages are drawn from once."""
    masked = materialize(scoring.loss_counts(spark, sf), "loss-counts")
    return packet_loss_rows(masked).unionByName(budget_rows(masked), allowMissingColumns=True)


def key_mode_rows(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_key_modes(spark, sf).withColumns({
        "system": F.lit("sketch"), "loss_prob": F.lit(S.INTERMITTENT_PROB),
        "state_entries": F.lit(CELLS).cast("bigint"), "alerts": F.col("pp"),
    })
    return experiment(scored, "sketch_key_sensitivity", "Q2")


def straggler_rows(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_straggler(spark, sf).select(
        "seed", "delay_ms", "observed_rounds", "precision", "recall"
    )
    return experiment(
        systems(scored, ["precision", "recall"], [
            ("dataflow", F.col("observed_rounds"), None),
            ("schedule_aware", F.lit(1), None),
            ("sketch", F.lit(None), NO_ARGMAX),
        ]),
        "straggler", "Q3",
    )


def round_failure_rows(spark: SparkSession, sf: str) -> DataFrame:
    metrics = ["precision", "recall", "false_positive_rate", "time_to_detection_ms", "alerts"]
    scored = scoring.fault_scores(spark, sf).withColumn("alerts", F.col("pp")).select(
        "seed", "fault_type", F.lit(S.TIMEOUT_US / 1000.0).alias("timeout_ms"), "largest_round",
        *metrics,
    )
    windowed = F.greatest(
        F.col("largest_round"), F.lit(max(S.EXPECTED_ROUND, S.N_WORKERS * S.N_CHUNKS))
    )
    return experiment(
        systems(scored, metrics, [
            ("dataflow_windowed", windowed, None),
            ("schedule_aware", F.lit(S.N_WORKERS + S.N_CHUNKS), None),
            ("sketch", F.lit(None), NO_EXPECTED_SET),
        ]),
        "round_failure", "Q4",
    )


def interference_rows(spark: SparkSession, sf: str) -> DataFrame:
    common = {
        "window_size": F.lit(S.CORR_WINDOW),
        "interference_delay_ms": F.lit(S.INTERFERENCE_DELAY_US / 1000.0),
    }
    scored = materialize(scoring.score_interference(spark, sf), "interference-scores")
    monitors = scored.withColumns({
        **common, "state_entries": F.lit(2 * S.CORR_WINDOW).cast("bigint"),
        "alerts": F.col("pp"),
    })
    others = systems(
        scored.filter(F.col("system") == "schedule_aware").select("seed"), [],
        [("dataflow", F.lit(None), NO_CORRELATION), ("sketch", F.lit(None), NO_CORRELATION)],
    ).withColumns(common)
    return experiment(
        monitors.unionByName(others, allowMissingColumns=True).withColumn(
            "expressible", F.coalesce("expressible", F.lit(True))
        ),
        "interference", "Q5", n_jobs=2,
    )


def control_rows(spark: SparkSession, sf: str) -> DataFrame:
    rates = scoring.control_rates(
        scoring.control_marks(spark, sf), ["query", "control_type"]
    ).withColumns({
        "system": F.lit("dataflow_control"),
        "state_entries": F.when(F.col("query") == "Q3", F.col("rounds"))
        .otherwise(F.col("rounds") * S.N_WORKERS).cast("bigint"),
    })
    return experiment(rates, "negative_control", "")


EXPERIMENTS = (
    loss_rows, key_mode_rows, straggler_rows, round_failure_rows, interference_rows,
    control_rows, job_count_rows,
)


def run_experiments(spark: SparkSession, sf: str, experiments=EXPERIMENTS) -> DataFrame:
    """Complete result rows of the given experiments, each written to its own table.

    The experiments do not depend on each other, so their jobs are submitted side by side.
    """
    root = work_path(spark, "result-rows")

    def write(rows) -> tuple[str, object]:
        sized = profile.state_cost(rows(spark, sf)).withColumn(
            "packets", profile.modelled_messages()
        )
        complete = summary.result_rows(sized)
        path = f"{root}/{rows.__name__}"
        complete.write.parquet(path)
        return path, complete.schema

    with ThreadPoolExecutor(len(experiments)) as pool:
        written = list(pool.map(write, experiments))
    return spark.read.schema(written[0][1]).parquet(*[path for path, _ in written])


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    return run_experiments(spark, sf)


def summary_ci95(spark: SparkSession, sf: str) -> DataFrame:
    return summary.sorted_summary(summary.summarize(run_experiments(spark, sf)))


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall by loss probability, and state as bytes or else entries."""
    sized = profile.state_cost(packet_loss_rows(scoring.loss_counts(spark, sf)))
    rows = summary.result_rows(sized).withColumn(
        "state", F.coalesce("register_bytes", "state_entries")
    )
    return summary.metric_points(rows, "loss_prob", ["precision", "recall", "state"])


def na_systems(spark: SparkSession, sf: str) -> DataFrame:
    """Systems that cannot express a workload, from result rows written and read as CSV."""
    path = work_path(spark, "result-csv")
    rows = run_experiments(spark, sf, (straggler_rows, round_failure_rows, interference_rows))
    results.write_csv(rows.select("workload", "system", "expressible"), path)
    return summary.not_applicable(results.read_csv(spark, path))


QUERIES = named(
    state_profile, state_totals, state_by_jobs, result_rows, summary_ci95, metric_series,
    na_systems,
)
