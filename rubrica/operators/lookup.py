"""Joining a large table to a smaller one on keys that may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.session import materialize

# Bytes of values up to which the smaller side is broadcast; summed up before planning.
BROADCAST_BYTES = 64 * 1024 * 1024
# Frequent keys that are looked up by broadcast where the whole table is too large for it.
FREQUENT_KEYS = 1 << 18
# Rows of one key that a task should meet; a key with more is spread over as many sub-keys as it takes.
ROWS_PER_KEY = 1 << 20


def _bytes_of(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(column), F.lit(0)) * 8
    return F.lit(8)


def fits_broadcast(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``small`` add up to few enough bytes (one distributed count)."""
    row = sum((_bytes_of(f) for f in small.schema.fields), F.lit(0).cast("long"))
    return (small.agg(F.sum(row)).first()[0] or 0) <= max_bytes


def _frequent(counts: DataFrame, small: DataFrame, on: list[str]) -> DataFrame | None:
    """The most frequent keys with what they find, if they are few and hold half of all rows; else None.

    Frequency classes are powers of two: at most 64 rows come to the driver.
    """
    level = F.floor(F.log2("_n")).alias("_level")
    classes = counts.groupBy(level).agg(F.sum("_n").alias("rows"), F.count("*").alias("keys")).collect()
    every, rows, keys, least = sum(c["rows"] for c in classes), 0, 0, None
    for c in sorted(classes, key=lambda c: -c["_level"]):
        if keys + c["keys"] > FREQUENT_KEYS:
            break
        rows, keys, least = rows + c["rows"], keys + c["keys"], c["_level"]
    if least is None or 2 * rows < every:
        return None
    found = counts.filter(F.floor(F.log2("_n")) >= least).select(*on).dropna()
    found = materialize(found.join(small, on, "left"), "frequent-keys")
    return found if fits_broadcast(found) else None


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], small_fits: bool | None = None
) -> DataFrame:
    """Left join of ``big`` to ``small`` (at most one row per key in ``small``).

    A small side of checked size is broadcast.  Beyond that the keys of ``big`` are counted.  If a few of
    them hold most rows, as words do, these keys are broadcast with what they find and only the other rows
    go on.  Then both sides are shuffled, and the rows of a hot key are spread over sub-keys by the hash of
    ``spread_by``, as many as its count asks for, against as many copies of the row they meet.  The list of
    hot keys is broadcast after the same size check.  ``small_fits`` is the outcome of the size check where
    it is known.
    """
    if fits_broadcast(small) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), on, "left")
    counts = materialize(big.groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    frequent = _frequent(counts, small, on)
    if frequent is not None:
        met = big.join(F.broadcast(frequent), on)
        listed = F.broadcast(frequent.select(*on))
        rest = _shuffled(big.join(listed, on, "left_anti"), small, on, spread_by, counts.join(listed, on, "left_anti"))
        return met.unionByName(rest)
    return _shuffled(big, small, on, spread_by, counts)


def _shuffled(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], counts: DataFrame) -> DataFrame:
    copies = F.ceil(F.col("_n") / ROWS_PER_KEY).cast("int")
    hot = counts.filter(F.col("_n") > ROWS_PER_KEY).select(*on, copies.alias("_copies"))
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    copies = F.coalesce("_copies", F.lit(1))
    slot = F.pmod(F.xxhash64(*spread_by), copies).cast("int")
    left = big.join(hot, on, "left").withColumn("_slot", slot).drop("_copies")
    right = small.join(hot, on, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return left.join(right, [*on, "_slot"], "left").drop("_slot")
