"""Count-Sketch as grouped sums of signed counts.

A sketch is linear, so its table is an ordinary aggregate: it combines on the map side, merges
by adding, and takes one weighted update per distinct key instead of one per message. Table
size depends on width, depth and the number of sketches only, never on the data, which is what
allows probing it by a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundscope.functions.hashing import sampling_level, sign, sketch_digest, u32
from roundscope.session import broadcast_if_bounded

#: Defaults that results depend on (fixed values).
WIDTH = 1024
DEPTH = 5
SEED = 42


def _hashed(keys: DataFrame, key: str, depth: int, seed: Column) -> DataFrame:
    """One row per key and sketch row, with the key's hash and sign in that row."""
    digest = sketch_digest(F.col(key), F.col("depth_row"), seed)
    return (
        keys.withColumn("depth_row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
        .withColumn("_digest", digest)
        .withColumn("_hash", u32(F.col("_digest")))
        .withColumn("_sign", sign(F.col("_digest")))
        .drop("_digest")
    )


def sketch_table(
    weighted: DataFrame,
    key: str = "key",
    weight: str = "cnt",
    width: int | Column = WIDTH,
    depth: int = DEPTH,
    seed: int | Column = SEED,
    by: list[str] | None = None,
) -> DataFrame:
    """Non-zero cells ``(*by, depth_row, idx, v)`` of one sketch per value of ``by``."""
    by = by or []
    seed_col = F.lit(seed) if isinstance(seed, int) else seed
    idx = (F.col("_hash") % (F.lit(width) if isinstance(width, int) else width)).cast("int")
    return (
        _hashed(weighted, key, depth, seed_col)
        .groupBy(*by, "depth_row", idx.alias("idx"))
        .agg(F.sum(F.col("_sign") * F.col(weight)).cast("bigint").alias("v"))
    )


def with_levels(weighted: DataFrame, levels: int, key: str = "key") -> DataFrame:
    """A row per level that a key enters, from 0 up to its sampled one."""
    return weighted.withColumn(
        "level", F.explode(F.sequence(F.lit(0), sampling_level(F.col(key), levels)))
    )


def merge_tables(tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One sketch per value of ``by`` from any number of partial ones: cells add up."""
    return tables.groupBy(*(by or []), "depth_row", "idx").agg(F.sum("v").alias("v"))


def level_tables(
    weighted: DataFrame, levels: int, key: str = "key", weight: str = "cnt",
    width: int = WIDTH, depth: int = DEPTH, seed: int = SEED,
) -> DataFrame:
    """Cells of a hierarchy of sketches; a key enters every level up to its sampled one."""
    leveled = with_levels(weighted, levels, key)
    return sketch_table(leveled, key, weight, width, depth, F.col("level") + seed, by=["level"])


def _median(rows: list[Column]) -> Column:
    """Upper median of the row estimates; a missing cell estimates 0."""
    return F.sort_array(F.array(*[F.coalesce(r, F.lit(0)) for r in rows]))[len(rows) // 2]


def _readout(probed: DataFrame, id_columns: list[str], depth: int) -> DataFrame:
    """Collect the row estimates of each key side by side and take their median."""
    signed = F.col("_sign") * F.col("v")
    names = [f"_r{r}" for r in range(depth)]
    per_row = [
        F.max(F.when(F.col("depth_row") == r, signed)).alias(name) for r, name in enumerate(names)
    ]
    median = _median([F.col(name) for name in names])
    return probed.groupBy(*id_columns).agg(*per_row).select(
        *id_columns, F.greatest(median, F.lit(0)).cast("bigint").alias("est")
    )


def point_estimates(
    keys: DataFrame,
    table: DataFrame,
    id_columns: list[str],
    key: str = "key",
    width: int = WIDTH,
    depth: int = DEPTH,
    seed: int = SEED,
    by: list[str] | None = None,
    sketches: int = 1,
) -> DataFrame:
    """Estimate of each key: median over rows of the signed cells it hits, not below 0.

    ``sketches`` is the number of tables in ``table`` (distinct values of ``by``), a parameter
    that bounds the broadcast. The final grouping is by ``id_columns``: keys that arrive hash
    partitioned by them are not shuffled again.
    """
    by = by or []
    cells = broadcast_if_bounded(table, width * depth * sketches)
    probes = _hashed(keys.select(*id_columns, key), key, depth, F.lit(seed)).withColumn(
        "idx", (F.col("_hash") % width).cast("int")
    )
    return _readout(probes.join(cells, [*by, "depth_row", "idx"], "left"), id_columns, depth)


def width_sweep(
    weighted: DataFrame, id_columns: list[str], widths: list[int],
    key: str = "key", weight: str = "cnt", depth: int = DEPTH, seed: int = SEED,
    by: list[str] | None = None, sketches: int = 1,
) -> DataFrame:
    """Estimates of each key for several widths. Keys are hashed once; only the modulus varies."""
    by = [*(by or []), "sketch_width"]
    ids = [*by[:-1], *id_columns, weight]
    hashed = _hashed(weighted.select(*ids, key), key, depth, F.lit(seed))
    by_width = hashed.withColumn(
        "sketch_width", F.explode(F.array(*[F.lit(w) for w in widths]))
    ).withColumn("idx", (F.col("_hash") % F.col("sketch_width")).cast("int"))
    table = by_width.groupBy(*by, "depth_row", "idx").agg(
        F.sum(F.col("_sign") * F.col(weight)).cast("bigint").alias("v")
    )
    cells = broadcast_if_bounded(table, sum(widths) * depth * sketches)
    return _readout(by_width.join(cells, [*by, "depth_row", "idx"], "left"),
                    [*ids, "sketch_width"], depth)


def heavy_hitters(estimates: DataFrame, threshold: int) -> DataFrame:
    return estimates.filter(F.col("est") >= threshold)


def shared_estimates(
    counts: DataFrame, id_columns: list[str], projected: list[str], key: Column,
    width: int = WIDTH, depth: int = DEPTH, salts: int = 16,
    by: list[str] | None = None, sketches: int = 1,
) -> DataFrame:
    """Sketch on a coarser key, its estimate shared evenly over the finer keys it covers.

    A coarse key may cover a large share of all fine keys, so the join back is salted: fine
    rows are spread over ``salts`` and the coarse table, one row per coarse key, is repeated.
    When nothing is collapsed the coarse keys are the fine keys and no salt is needed. ``by``
    keeps separate sketches, of which there are ``sketches``.
    """
    by = by or []
    coarse_ids = [*by, *projected]
    coarse = (
        counts.groupBy(*coarse_ids)
        .agg(F.sum("cnt").cast("bigint").alias("cnt"), F.count(F.lit(1)).alias("fanout"))
        .withColumn("key", key)
    )
    table = sketch_table(coarse, width=width, depth=depth, by=by)
    estimates = point_estimates(
        coarse, table, [*coarse_ids, "fanout"], width=width, depth=depth, by=by,
        sketches=sketches,
    )
    share = F.greatest(
        F.bround(F.col("est") / F.greatest(F.col("fanout"), F.lit(1)), 0), F.lit(0)
    ).cast("bigint")
    kept = [*by, *id_columns, "cnt"]
    if set(projected) == set(id_columns):
        joined = counts.select(*kept).join(estimates, coarse_ids)
    else:
        repeated = estimates.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        )
        salt = F.pmod(F.hash(*id_columns), F.lit(salts))
        joined = counts.select(*kept, salt.alias("_salt")).join(
            repeated, [*coarse_ids, "_salt"]
        )
    return joined.select(*kept, share.alias("est"))
