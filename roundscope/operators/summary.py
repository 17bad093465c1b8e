"""Result rows to confidence-interval summaries and series tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.functions.numeric import ci95, is_false

# The fields that identify a configuration and the metrics summarised over seeds.
GROUP_FIELDS = {
    "workload": "string",
    "query": "string",
    "system": "string",
    "expressible": "boolean",
    "n_workers": "int",
    "n_chunks": "int",
    "n_rounds": "int",
    "n_jobs": "int",
    "delay_ms": "double",
    "loss_prob": "double",
    "fault_type": "string",
    "timeout_ms": "double",
    "window_size": "int",
    "interference_delay_ms": "double",
    "key_mode": "string",
    "sketch_width": "int",
    "control_type": "string",
    "scaling_model": "string",
}
METRIC_FIELDS = (
    "precision",
    "recall",
    "state_entries",
    "counter_bits",
    "register_bytes",
    "keys_tracked",
    "per_packet_ops",
    "false_positive_rate",
    "packets",
    "observed_rounds",
    "time_to_detection_ms",
    "alerts",
)
UNIT_METRICS = ("precision", "recall")
SORT_FIELDS = (
    "workload", "query", "system", "n_workers", "delay_ms", "loss_prob", "fault_type",
    "timeout_ms", "window_size", "interference_delay_ms", "key_mode", "control_type",
    "scaling_model", "n_jobs", "sketch_width",
)


def result_rows(rows: DataFrame) -> DataFrame:
    """Complete a partial result table to the full schema; unset fields are null."""
    def field(name: str, kind: str):
        source = F.col(name) if name in rows.columns else F.lit(None)
        return source.cast(kind).alias(name)

    return rows.select(
        *[field(name, kind) for name, kind in GROUP_FIELDS.items()],
        field("seed", "int"),
        *[field(name, "double") for name in METRIC_FIELDS],
        field("reason", "string"),
    )


def summarize(rows: DataFrame) -> DataFrame:
    """Count, seed range, and mean with 95 % bounds of each metric per configuration."""
    columns = [
        F.count(F.lit(1)).alias("n_samples"),
        F.min("seed").alias("seed_min"),
        F.max("seed").alias("seed_max"),
    ]
    for metric in METRIC_FIELDS:
        bounds = ci95(metric, unit_interval=metric in UNIT_METRICS)
        for column, suffix in zip(bounds, ("mean", "ci95_low", "ci95_high"), strict=True):
            columns.append(column.alias(f"{metric}_{suffix}"))
    return rows.groupBy(*GROUP_FIELDS).agg(*columns)


def sorted_summary(summary: DataFrame) -> DataFrame:
    """Display order; missing numbers sort as 0 and missing text as blank."""
    def key(name: str):
        blank = F.lit("") if GROUP_FIELDS[name] == "string" else F.lit(0)
        return F.coalesce(F.col(name), blank)

    return summary.orderBy(*[key(name) for name in SORT_FIELDS])


def metric_points(rows: DataFrame, x: str, metrics: list[str]) -> DataFrame:
    """Points by (system, workers, x) with bounds, aligned over the union of keys.

    Rows without ``x`` give no point; a metric that has no value at a key stays null there.
    """
    present = F.coalesce(*[F.col(m) for m in metrics]).isNotNull()
    columns = []
    for metric in metrics:
        bounds = ci95(metric, unit_interval=metric in UNIT_METRICS)
        for column, suffix in zip(bounds, ("mean", "low", "high"), strict=True):
            columns.append(column.alias(f"{metric}_{suffix}"))
    return (
        rows.filter(F.col(x).isNotNull() & present)
        .groupBy(
            "system",
            F.coalesce("n_workers", F.lit(0)).cast("int").alias("workers"),
            F.col(x).alias("x"),
        )
        .agg(*columns)
    )


def not_applicable(rows: DataFrame) -> DataFrame:
    """Per workload the sorted systems that cannot express the query, with a note."""
    systems = F.array_sort(F.collect_set("system"))
    return (
        rows.filter(is_false(F.col("expressible")) & (F.col("system") != ""))
        .groupBy("workload")
        .agg(systems.alias("_systems"))
        .select(
            "workload",
            F.concat(
                F.lit("N/A: "), F.array_join("_systems", ", "), F.lit(" not expressible")
            ).alias("note"),
        )
    )
