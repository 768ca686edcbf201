"""Cosine similarity of vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.binding import bind
from rubrica.functions.numeric import clamp01, round4, safe_value


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, unit: bool = True) -> Column:
    """Cosine clamped to [0, 1], 4 decimals; 0 for a missing or zero vector."""
    raw = dot(a, b)
    if not unit:
        raw = bind(F.sqrt(dot(a, a) * dot(b, b)), lambda norms: F.when(norms > 0, dot(a, b) / norms))
    return bind(raw, lambda x: round4(clamp01(safe_value(x))))
