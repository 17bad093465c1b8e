"""Workers below what their job's workers usually send, on rows made here."""

from __future__ import annotations

import pytest
from compare import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from roundscope.sources.bindings import DAY_US, EVENT_START_US

#: Messages of the eight workers in each round of a job; usual are 4 of `add` and 100 of `view`.
SENT = {
    ("add", 0): [4] * 8,
    ("add", 1): [4, 4, 4, 3, 4, 4, 4, 4],
    ("add", 2): [4, 4, 2, 4, 4, 0, 4, 4],
    ("add", 3): [5, 4, 4, 4, 3, 4, 3, 6],
    ("view", 0): [100] * 8,
    ("view", 1): [100, 99, 100, 100, 100, 100, 100, 100],
    ("view", 2): [100, 100, 100, 100, 100, 100, 70, 80],
}
#: Job, round, worker with the lowest count below the usual one, its count; no row for full rounds.
SHORT = [(0, 1, 3, 3), (0, 2, 5, 0), (0, 3, 4, 3), (1, 1, 1, 99), (1, 2, 6, 70)]


@pytest.fixture
def sent(spark, tmp_path):
    """A folder whose events are the messages of ``SENT``."""
    rows = [
        (kind, day, worker, n) for (kind, day), counts in SENT.items()
        for worker, n in enumerate(counts)
    ]
    each = spark.createDataFrame(rows, "event_type string, day bigint, worker bigint, n int")
    each = each.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.col("worker") + 8 * F.col("i") + F.when(F.col("event_type") == "add", 0).otherwise(4096)
    micros = F.lit(EVENT_START_US) + F.col("day") * DAY_US + key * 1_000_000
    each.select(
        (F.col("day") * 8192 + key).alias("event_id"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"),
        F.col("worker").alias("user_id"), "event_type", F.lit(1.0).alias("value"),
        F.lit("").alias("props"),
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def same_as_sql(duck, name, sent, frame) -> str:
    own = duck.cursor()
    own.execute("CREATE SCHEMA made")
    try:
        own.execute(f"CREATE VIEW made.events AS SELECT * FROM '{sent}/events.parquet/*.parquet'")
        own.execute("SET search_path = 'made,main'")
        found = own.execute(entry_points.ROUND_ORACLES[name])
        return compare(
            frame.columns, frame.collect(), [c[0] for c in found.description], found.fetchall()
        )
    finally:
        own.execute("SET search_path = 'main'")
        own.execute("DROP SCHEMA made CASCADE")
        own.close()


def test_every_worker_below_the_usual_count_is_short(spark, duck, sent):
    """One message short is short, as in a round with a silent worker; full rounds are absent."""
    frame = entry_points.ROUND_QUERIES["q2_lossy_worker"](spark, sent)
    found = frame.select("job_id", "round_id", "worker_id", "cnt").collect()
    assert sorted(map(tuple, found)) == SHORT
    assert same_as_sql(duck, "q2_lossy_worker", sent, frame) == ""


def test_result_rows_name_every_short_worker_after_csv(spark, duck, sent):
    """Both result tables come back whole: a latency for each round, a row for each short worker."""
    frame = entry_points.ROUND_QUERIES["results_csv_roundtrip"](spark, sent)
    low = frame.filter("query = 'Q2' and latency_us is null")
    found = low.select("job_id", "round_id", "worker_id", "cnt").collect()
    assert sorted(map(tuple, found)) == SHORT
    latency = frame.filter("query = 'Q1' and latency_us is not null and worker_id is null")
    assert latency.count() == len(SENT)
    assert frame.count() == len(SENT) + len(SHORT)
    assert same_as_sql(duck, "results_csv_roundtrip", sent, frame) == ""
