"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is planned and computed once, however often ``body`` uses it.

    Without it an expression that uses its input several times grows with every nesting.
    """
    return F.transform(F.array(value), body)[0]
