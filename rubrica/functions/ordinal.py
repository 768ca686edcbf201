"""Class probabilities from cumulative binary probabilities, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.binding import bind
from rubrica.functions.numeric import clamp01


def class_probabilities(greater: Sequence[Column]) -> Column:
    """Array of K class probabilities from the K-1 columns ``P(y > class i)``.

    Differences of neighbours, clipped to [0, 1] and divided by their sum (0 counts as 1).
    """
    edges = [F.lit(1.0), *greater, F.lit(0.0)]
    parts = F.array(*[clamp01(above - below) for above, below in zip(edges, edges[1:])])

    def normalized(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        divisor = bind(total, lambda t: F.when(t == 0, 1.0).otherwise(t))
        return bind(divisor, lambda d: F.transform(values, lambda x: x / d))

    return bind(parts, normalized)


def most_likely(probabilities: Column, classes: Sequence[int]) -> Column:
    """Class of the largest probability; ties go to the lowest class."""
    place = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(int(c)) for c in classes]), place)


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
