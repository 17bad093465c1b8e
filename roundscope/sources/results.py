"""CSV sink and source for result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def append_rows(tables: list[DataFrame]) -> DataFrame:
    """Bag union over the union of columns, in sorted column order; missing cells are null."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return merged.select(*sorted(merged.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows with a header. Without a schema every column is text."""
    reader = spark.read.option("nullValue", "")
    if schema:
        return reader.schema(schema).csv(path, header=True)
    return reader.csv(path, header=True, inferSchema=False)


def read_preferred(spark: SparkSession, summary: str, raw: str) -> DataFrame:
    """The summary file when it exists, otherwise the raw rows."""
    try:
        return read_csv(spark, summary)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_csv(spark, raw)
