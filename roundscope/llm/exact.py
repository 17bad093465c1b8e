"""Exact deduplication as a stream with keyed state that never expires.

Documents arrive as files. For each digest of a normalised text the state keeps the first document
that brought it (its id, and as content locator its file and row), the document that stays, and how
many came. The state lives on disk (RocksDB) under the store's checkpoint, so a later run over more
files goes on from it. Tasks send one partial row per digest, so a text that a third of all documents
share sends few rows, and no text is shuffled for the state.

A digest alone decides nothing: every document that hits a digest is compared in full with the
content at the retained locator. Documents whose bytes differ leave the class and are grouped by
their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.session import materialize, work_path

#: Characters that do not count when texts are compared; fixed by the definition of equal texts.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Micro-batches in which a table that is there from the start is taken in.
BATCHES = 4
#: Least and largest number of partitions of the state, else one per file of the first run. It is
#: fixed for the life of a store.
FEWEST, MOST = 8, 8192
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Else each of many small stores takes megabytes of disk ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(table: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, norm, points, digest`` and the place of each stored row, ``file, place``."""
    stored = table.metadataColumn("_metadata")
    rows = table.select(
        "doc_id", normalised(F.col("text")).alias("norm"),
        F.length(F.coalesce("text", F.lit(""))).alias("points"),
        stored["file_path"].alias("file"), stored["row_index"].alias("place"),
    )
    return rows.withColumn("digest", digest(F.col("norm")))


def _best() -> Column:
    """The document of a class that stays: longest, then least doc_id, then first in its file."""
    return F.min(F.struct(
        (-F.col("points")).alias("order"), F.col("doc_id").isNull().alias("unnamed"), "doc_id",
        "file", "place",
    )).alias("best")


def ingest(
    spark: SparkSession, path: str, store: str, digest: Callable[[Column], Column] = sha256,
    batches: int = BATCHES,
) -> None:
    """Take the files below ``path`` that the store has not seen into its state.

    Each micro-batch writes the classes that it changed; a batch that is repeated after a failure
    overwrites its own rows only, and the arrival time of a batch is in the stream's log.
    """
    table = spark.read.parquet(path)
    files = max(len(table.inputFiles()), 1)
    session = spark.newSession()
    partitions = min(MOST, max(FEWEST, files))
    for key, value in {**ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}.items():
        session.conf.set(key, value)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = (
        session.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", math.ceil(files / batches))
        # A pattern that matches one name: a stream may not begin at a single file.
        .parquet(f"{folder}/{{{name}}}")
    )
    arrival = F.unix_millis(F.current_timestamp())
    state = _located(stream, digest).withColumn("arrival", arrival).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("arrival", "file", "place", "doc_id")).alias("first"),
        _best(),
    )
    log = f"{store}/classes"
    # So that a table without rows has a log too.
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{log}/batch_id=-1")

    def changed(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    (
        state.writeStream.outputMode("update").foreachBatch(changed)
        .option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )


def classes(spark: SparkSession, store: str) -> DataFrame:
    """The state after the last batch: ``digest, n, first, best``."""
    return spark.read.parquet(f"{store}/classes").groupBy("digest").agg(
        F.max_by(F.struct("n", "first", "best"), "batch_id").alias("_last")
    ).select("digest", "_last.*")


def members(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Every document with its class; the text of those whose digest came more than once."""

    def here(row: str) -> Column:
        return (F.col("file") == F.col(f"{row}.file")) & (F.col("place") == F.col(f"{row}.place"))

    return rows.join(state, "digest").select(
        "doc_id", "digest", "points", "file", "place", "n",
        F.col("best.doc_id").alias("keep_id"), here("best").alias("kept"),
        here("first").alias("retained"), F.when(F.col("n") > 1, F.col("norm")).alias("norm"),
        F.lower(F.hex(sha256(F.col("norm")))).alias("text_sha256"),
    )


def differing(found: DataFrame) -> DataFrame:
    """Digests under which some document's bytes are not those at the retained locator."""
    hits = found.filter("n > 1")
    content = hits.filter("retained").select("digest", F.col("norm").alias("content"))
    others = hits.filter("not retained").select("digest", "norm")
    return others.join(content, "digest").filter("norm != content").select("digest")


def deduplicate(
    spark: SparkSession, path: str, store: str | None = None,
    digest: Callable[[Column], Column] = sha256, batches: int = BATCHES,
) -> DataFrame:
    """Per stored row of ``path``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal that are identical without blanks; of equal ones the longest original (code
    points), then the least doc_id stays. Null, empty and blank texts are equal to each other. Rows
    without a doc_id come last, and of rows alike in both the first by file and place stays, so that
    exactly one row of a class does, whatever repeats. Columns beyond ``doc_id, text`` are not looked
    at; a table without rows gives none. With a ``store`` from an earlier run only new files are
    taken in; results are for all files below ``path``, none of which may have gone or changed.
    """
    store = store or work_path(spark, "exact-store")
    ingest(spark, path, store, digest, batches)
    state = materialize(classes(spark, store), "exact-classes")
    rows = _located(spark.read.parquet(path), digest)
    found = materialize(members(rows, state), "exact-members")
    # No grouping here, so that the join of a text that very many share can be split.
    wrong = materialize(differing(found), "exact-differing")
    result = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256"]
    if wrong.isEmpty():
        return found.select(*result)
    right = found.join(wrong, "digest", "left_anti").select(*result)
    apart = found.join(wrong, "digest", "left_semi").drop("n", "keep_id", "kept")
    by_bytes = apart.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), _best())
    return right.unionByName(apart.join(by_bytes, ["digest", "norm"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("place") == F.col("best.place")))
        .alias("kept"), "text_sha256",
    ))
