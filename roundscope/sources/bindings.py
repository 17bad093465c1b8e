"""Bind stored tables to the message schema.

A message row is ``ts_us, job_id, round_id, worker_id, chunk_id, size, seq``; time is integer
microseconds and ``seq`` is the arrival order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundscope.session import materialize

DAY_US = 86_400_000_000
#: Midnight of the first event day, in microseconds.
EVENT_START_US = 1_704_067_200_000_000
#: Up to so many names are put into the plan, as no join is then needed; more are joined.
FEW_NAMES = 64

MESSAGE_COLUMNS = ("ts_us", "job_id", "round_id", "worker_id", "chunk_id", "size", "seq")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, its zoneless timestamps read as UTC instants.

    An instant is the stored number itself, so getting microseconds costs nothing per row.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    zoneless = [f.name for f in table.schema if isinstance(f.dataType, T.TimestampNTZType)]
    if not zoneless:
        return table
    instants = T.StructType([
        T.StructField(f.name, T.TimestampType() if f.name in zoneless else f.dataType)
        for f in table.schema
    ])
    return spark.read.schema(instants).parquet(path)


def whole(value: Column, divisor: int) -> Column:
    """Integer quotient of whole numbers, without a detour over doubles."""
    return F.call_function("div", value, F.lit(divisor))


class Names(NamedTuple):
    """Distinct names of a column with their ranks from 0: as a table, and as a list while few."""

    table: DataFrame
    few: list[tuple[str, int]] | None


#: What was ranked before, by application, files and column.
_ranked: dict[tuple, Names] = {}


def ranked_names(table: DataFrame, column: str) -> Names:
    """Rank the names of a column once per application and stored table, into the shared folder.

    Later calls for the same files neither read nor write anything.
    """
    files = tuple(table.inputFiles())
    key = (table.sparkSession.sparkContext.applicationId, column, FEW_NAMES, files)
    if not files or key not in _ranked:
        names = table.select(F.col(column).alias("name")).filter("name is not null").distinct()
        rank = F.row_number().over(Window.orderBy("name")) - 1
        ranked = materialize(names.select("name", rank.cast("int").alias("number")), "names")
        first = ranked.orderBy("number").limit(FEW_NAMES + 1).collect()
        few = [(r["name"], r["number"]) for r in first] if len(first) <= FEW_NAMES else None
        if not files:
            return Names(ranked, few)
        _ranked[key] = Names(ranked, few)
    return _ranked[key]


def numbered(table: DataFrame, column: str, names: Names, number: str) -> DataFrame:
    """``table`` with the rank of each name; only rows without a name get -1."""
    if names.few is None:
        dimension = names.table.select(F.col("name").alias("_name"), F.col("number").alias("_number"))
        joined = table.join(dimension, F.col(column) == F.col("_name"), "left")
        return joined.withColumn(number, F.coalesce("_number", F.lit(-1))).drop("_name", "_number")
    chain = F.when(F.col(column).isNull(), F.lit(-1))
    for name, rank in names.few:
        chain = chain.when(F.col(column) == name, F.lit(rank))
    return table.withColumn(number, chain.otherwise(F.lit(-1)))


def event_messages(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``events``: job = rank of the event type, round = day, worker = user mod 8, chunk = half day.

    Types are ranked over the whole ``stored`` table, of which ``events`` are a part or a stream. Round and chunk are integer arithmetic on the microseconds since the first event day.
    """
    since_start = F.unix_micros("ts") - F.lit(EVENT_START_US)
    in_day = F.pmod(since_start, F.lit(DAY_US))
    names = ranked_names(events if stored is None else stored, "event_type")
    return numbered(events, "event_type", names, "job_id").select(
        F.unix_micros("ts").alias("ts_us"),
        "job_id",
        whole((since_start - in_day), DAY_US).cast("int").alias("round_id"),
        (F.col("user_id") % 8).cast("int").alias("worker_id"),
        whole(in_day, DAY_US // 2).cast("int").alias("chunk_id"),
        F.col("value").alias("size"),
        F.col("event_id").alias("seq"),
    )


def line_messages(lineitem: DataFrame) -> DataFrame:
    """``lineitem``: job = rank of the return flag, round = ship month, worker = supplier mod 16."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    names = ranked_names(lineitem, "l_returnflag")
    return numbered(lineitem, "l_returnflag", names, "job_id").select(
        F.unix_micros("l_shipdate").alias("ts_us"),
        "job_id",
        month.cast("int").alias("round_id"),
        (F.col("l_suppkey") % 16).cast("int").alias("worker_id"),
        F.col("l_linenumber").alias("chunk_id"),
        F.col("l_quantity").alias("size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """``conversations``: round = conversation, worker = rank of the role, chunk = turn."""
    names = ranked_names(conversations, "role")
    return numbered(conversations, "role", names, "worker_id").select(
        F.lit(0).alias("job_id"),
        F.col("conv_id").alias("round_id"),
        "worker_id",
        F.col("turn").alias("chunk_id"),
    )


def event_jobs(rounds: DataFrame, extra_rounds: int = 2) -> DataFrame:
    """Job dimension of the event binding, from any table that has ``job_id, round_id``.

    Each job is scheduled for its observed rounds plus ``extra_rounds`` later ones, so that
    rounds without a single message are part of the schedule.
    """
    return rounds.groupBy("job_id").agg(
        F.lit(8).alias("n_workers"),
        F.lit(2).alias("n_chunks"),
        (F.max("round_id") + 1 + extra_rounds).cast("int").alias("n_rounds"),
        F.lit(EVENT_START_US).cast("bigint").alias("start_offset_us"),
        F.lit(DAY_US).cast("bigint").alias("round_duration_us"),
        F.lit(0).cast("bigint").alias("inter_round_gap_us"),
    )
