"""Run a streaming plan over stored files until they are used up.

Sinks, checkpoints and control files live in the shared working folder. A finite replay ends
with one row far in the future that moves the watermark past every open round; a live stream
needs none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roundscope.session import work_path

#: Time of the row that ends a finite replay.
END_OF_TIME = "2999-01-01 00:00:00"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def end_row(spark: SparkSession, schema: T.StructType, time: str = "ts") -> DataFrame:
    """A row far in the future that has nothing but a time."""
    return spark.range(1).select(*[
        (F.lit(END_OF_TIME) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def stream_session(spark: SparkSession, files: int) -> SparkSession:
    """A session of its own for a stream: its state in RocksDB.

    State has as many partitions as shuffles of the caller, or two per file of a small table.
    """
    session = spark.newSession()
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, 2 * files))
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return session


def ordered_feed(stored: DataFrame, time: str, parts: int) -> tuple[str, int]:
    """Write a stored table as files in time order, one part after another; path and files a part.

    Each part is as many files as the table has, so a replay can take in part by part; the row that
    ends the replay comes last.
    """
    spark = stored.sparkSession
    path = work_path(spark, "feed")
    files = max(len(stored.inputFiles()), 1)
    micros = F.unix_micros(time)
    low, high = stored.agg(F.min(micros), F.max(micros)).first()
    step = 0 if low is None else (high - low) // parts + 1
    for part in range(parts):
        nth = stored if low is None else stored.filter(
            (micros >= low + part * step) & (micros < low + (part + 1) * step)
        )
        nth.repartition(files).write.mode("append").parquet(path)
        if low is None:
            break
    end_row(spark, stored.schema, time).write.mode("append").parquet(path)
    return path, files


class Replay:
    """A stored table as a stream, with a control stream that can end it.

    ``ended``: the files end with the far row themselves, as an :func:`ordered_feed` does.
    ``late_rows`` counts the rows that came after the watermark, over all runs.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
        ended: bool = False,
    ) -> None:
        self.session = stream_session(spark, max_files or 1)
        self.spark, self.schema, self.max_files = spark, schema, max_files
        self.ended = ended
        self.root = work_path(spark, "stream")
        self.late_rows = 0
        self._control = f"{self.root}/control"
        spark.createDataFrame([], schema).write.parquet(self._control)
        if max_files is None:
            # Everything arrives in one micro-batch, so the end may arrive with it.
            self._write_end()
        self.rows = file_stream(self.session, path, schema, max_files).unionByName(
            file_stream(self.session, self._control, schema)
        )

    def _write_end(self) -> None:
        end_row(self.spark, self.schema).write.mode("append").parquet(self._control)

    def side_stream(self, table: DataFrame, label: str) -> DataFrame:
        """Another table as a stream of the same replay."""
        path = f"{self.root}/{label}"
        table.write.parquet(path)
        return file_stream(self.session, path, table.schema)

    def _run(self, start: Callable[[], StreamingQuery]) -> None:
        query = start()
        query.awaitTermination()
        for progress in query.recentProgress:
            self.late_rows += sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)

    def drain(self, start: Callable[[], StreamingQuery]) -> None:
        """Start the query with all stored files, then once more if they lack the ending row."""
        self._run(start)
        if self.max_files is not None and not self.ended:
            self._write_end()
            self._run(start)

    def to_table(self, plan: DataFrame) -> DataFrame:
        """Append-mode result of ``plan``, written to a table and read back."""
        out = f"{self.root}/out"
        self.drain(
            lambda: plan.writeStream.outputMode("append")
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .format("parquet")
            .start(out)
        )
        return self.spark.read.schema(plan.schema).parquet(out)

    def for_each_batch(
        self, plan: DataFrame, step: Callable[[DataFrame, int], None], mode: str
    ) -> None:
        self.drain(
            lambda: plan.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(step)
            .start()
        )

    def state(self, operator: int = 0) -> DataFrame:
        """Entries that an operator of the last run holds in its checkpoint: ``key``, ``value``."""
        return self.session.read.format("statestore").option("operatorId", operator).load(
            f"{self.root}/checkpoint"
        ).select("key", "value")
