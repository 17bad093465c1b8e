"""Session defaults and the shared working folder for written tables and stream state."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Row bound under which a side whose size follows from parameters alone is broadcast.
BROADCAST_ROW_LIMIT = 1_000_000

#: Whether a query's shuffle files go when it ends, not when its plan is forgotten.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: str | None = None
_shipped: set[str] = set()


def get_session(app: str = "roundscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and local merging of stream sessions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        # Plans are built from many columns; recording a call site for each one is slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Spark hands out the archive.

    Functions that run in Python workers import it, wherever the session was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="roundscope-"), "roundscope.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="roundscope-")
    return _local_root


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/roundscope/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back, cutting lineage.

    Nothing reads the shuffles of that write again, so Spark drops their files when it has ended.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast only when ``max_rows``, a bound set by parameters, is small.

    Above the limit the side stays unhinted: the join shuffles, or adaptive execution picks
    a broadcast after it has measured the side.
    """
    return df.hint("broadcast") if max_rows <= BROADCAST_ROW_LIMIT else df
