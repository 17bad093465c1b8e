"""MD5-based hashing that any SQL engine can reproduce: sketch buckets and uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*parts: Column) -> Column:
    """Canonical key text: ``(1, 2, 3)``, or ``(7,)`` for a single part."""
    if len(parts) == 1:
        return F.concat(F.lit("("), parts[0].cast("string"), F.lit(",)"))
    return F.concat(
        F.lit("("), F.concat_ws(", ", *[p.cast("string") for p in parts]), F.lit(")")
    )


def u32(digest: Column) -> Column:
    """First four digest bytes, little-endian, as a bigint."""
    pairs = [F.substring(digest, pos, 2) for pos in (7, 5, 3, 1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def sign(digest: Column) -> Column:
    """+1 or -1 from the lowest bit of the fifth digest byte."""
    odd = F.substring(digest, 10, 1).isin(*"13579bdf")
    return F.when(odd, F.lit(1)).otherwise(F.lit(-1))


def sketch_digest(key: Column, row: Column, seed: Column) -> Column:
    return F.md5(F.concat_ws("-", key, row.cast("string"), seed.cast("string")))


def sampling_level(key: Column, n_levels: int) -> Column:
    """Trailing zero bits of the key's hash, capped at ``n_levels - 1``."""
    h = u32(F.md5(key))
    return F.least(F.bit_count(h.bitwiseAND(-h) - F.lit(1)), F.lit(n_levels - 1)).cast("int")


def draw32(*parts: Column) -> Column:
    """Deterministic 32-bit draw from the given key parts and seed."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """Deterministic draw in [0, 1) from the given key parts and seed."""
    return draw32(*parts) / F.lit(4294967296.0)
