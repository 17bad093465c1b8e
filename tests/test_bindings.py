"""Jobs and workers are what the tables hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roundscope.plans import catalog
from roundscope.sources import bindings

KINDS = ["view", "add", "click", "wish", "error"]


@pytest.mark.parametrize("few", [64, 2])
def test_unlisted_event_types_and_flags_are_jobs_of_their_own(spark, tmp_path, monkeypatch, few):
    """Whether names are put into the plan or joined."""
    monkeypatch.setattr(bindings, "FEW_NAMES", few, raising=False)
    kind = F.array(*[F.lit(k) for k in KINDS])[(F.col("id") % 5).cast("int")]
    spark.range(100).select(
        F.timestamp_micros(F.lit(bindings.EVENT_START_US) + F.col("id") * 1_000_000).alias("ts"),
        F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"),
        F.when(F.col("id") < 95, kind).alias("event_type"), F.lit("").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    rows = catalog.QUERIES["q1_round_latency"](spark, str(tmp_path)).collect()
    assert sorted(r["job_id"] for r in rows) == [-1, 0, 1, 2, 3, 4]
    flag = F.array(*[F.lit(k) for k in "RANXY"])[(F.col("id") % 5).cast("int")]
    spark.range(100).select(
        F.timestamp_micros(F.lit(0).cast("bigint") + F.col("id")).alias("l_shipdate"),
        F.when(F.col("id") < 95, flag).alias("l_returnflag"), F.col("id").alias("l_suppkey"),
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    lost = catalog.QUERIES["q2_worker_counts"](spark, str(tmp_path)).groupBy("job_id").agg(
        F.sum("cnt")).collect()
    assert sorted(map(tuple, lost)) == [(-1, 5), *[(j, 19) for j in range(5)]]
    clicks = catalog.QUERIES["stream_q2_counts"](spark, str(tmp_path)).filter("job_id = 1")
    assert clicks.agg(F.sum("cnt")).first()[0] == 19


def test_unlisted_roles_are_workers_of_their_own(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", ""), (1, 1, "user", ""), (1, 2, "assistant", ""), (1, 3, "tool", "")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    found = bindings.conversation_messages(turns).select("worker_id").distinct().collect()
    assert sorted(r[0] for r in found) == [0, 1, 2, 3]
