"""Small parameter tables as literal relations, whose exact size the optimizer knows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return str(value)


def parameter_table(
    spark: SparkSession, schema: str, rows: Iterable[Sequence[object]]
) -> DataFrame:
    """``rows`` as a table; ``schema`` is a DDL string such as ``"seed int, prob double"``."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
