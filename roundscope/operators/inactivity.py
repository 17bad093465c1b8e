"""Missing and stalled rounds: inactivity timeout against an expected schedule.

An alert fires at ``last activity + timeout`` when the running count is still below the
expected total. Messages closer together than the timeout can never leave such a gap between
them, so they are first combined into time buckets no wider than the timeout. The ordered work
then sees at most one row per bucket, however many messages a round has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUND = ["job_id", "round_id"]


def activity_buckets(
    messages: DataFrame, width_us: int, by: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """First and last time and the count of each time bucket of each round.

    ``width_us`` must not exceed the smallest timeout used later. Messages without a time share
    one bucket with null times.
    """
    width = max(int(width_us), 1)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        messages.groupBy(*(by or ROUND), F.floor(F.col("ts_us") / width).alias("bucket"))
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            n.cast("bigint").alias("n"),
        )
    )


def inactivity_states(
    buckets: DataFrame,
    schedule: DataFrame,
    by: list[str] | None = None,
    hidden: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per scheduled round, ``detected_us`` being null where nothing fires.

    ``schedule`` carries ``start_us, end_us, expected, timeout_us`` for each key of ``by``; it
    may hold several variants of a round (timeouts, faults), which all share the round's
    buckets. ``hidden`` marks buckets that a variant does not get to see, and ``carry`` names
    schedule columns to keep. Activity without a time counts as arriving at the scheduled end.
    Buckets may overlap that arrival, so the last activity is a running maximum instead of the
    previous row.
    """
    keys = by or ROUND
    rows = schedule.join(buckets, ROUND, "left")
    if hidden is not None:
        shown = F.coalesce(~hidden, F.lit(True))
        for name in ("first_us", "last_us", "n"):
            rows = rows.withColumn(name, F.when(shown, F.col(name)))
    rows = (
        rows.withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn(
            "first_us",
            F.coalesce("first_us", F.when(F.col("n") > 0, F.col("end_us"))),
        )
        .withColumn("last_us", F.coalesce("last_us", "first_us"))
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("first_us", "last_us")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    gaps = (
        rows.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("idle_from", F.coalesce(F.max("last_us").over(before), F.col("start_us")))
        .withColumn("fires_at", F.col("idle_from") + F.col("timeout_us"))
        .withColumn(
            "fires", (F.col("seen") < F.col("expected")) & (F.col("first_us") > F.col("fires_at"))
        )
    )
    kept = [c for c in ("start_us", "expected", "timeout_us", *carry) if c not in keys]
    per_round = gaps.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in kept],
        F.min(F.when(F.col("fires"), F.col("fires_at"))).alias("fired_us"),
        F.min(F.when(F.col("fires"), F.col("seen"))).alias("seen"),
        F.max("last_us").alias("last_us"),
        F.sum("n").alias("total"),
    )
    at_end = F.coalesce("last_us", "start_us") + F.col("timeout_us")
    detected = F.coalesce("fired_us", F.when(F.col("total") < F.col("expected"), at_end))
    observed = F.coalesce("seen", "total")
    return per_round.select(
        *keys,
        detected.alias("detected_us"),
        observed.cast("bigint").alias("observed"),
        F.col("expected").cast("bigint").alias("expected"),
        F.when(detected.isNull(), F.lit(None))
        .when(observed == 0, F.lit("missing-round"))
        .when(F.col("total") >= F.col("expected"), F.lit("premature-timeout"))
        .otherwise(F.lit("missing-pairs"))
        .alias("reason"),
        "start_us",
        F.col("total").cast("bigint").alias("total"),
        *carry,
    )


def inactivity_alerts(
    buckets: DataFrame, schedule: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """The scheduled rounds whose timeout fires."""
    keys = by or ROUND
    return (
        inactivity_states(buckets, schedule, keys)
        .filter(F.col("detected_us").isNotNull())
        .select(*keys, "detected_us", "observed", "expected", "reason")
    )


def deadline_alerts(totals: DataFrame, schedule: DataFrame) -> DataFrame:
    """Alerts at the round deadline from totals alone (``job_id, round_id, observed``)."""
    observed = F.coalesce("observed", F.lit(0)).cast("bigint")
    return (
        schedule.join(totals, ROUND, "left")
        .withColumn("observed", observed)
        .filter(F.col("observed") < F.col("expected"))
        .select(
            *ROUND,
            F.col("deadline_us").alias("detected_us"),
            "observed",
            "expected",
            F.when(F.col("observed") == 0, F.lit("missing-round"))
            .otherwise(F.lit("missing-pairs"))
            .alias("reason"),
        )
    )
