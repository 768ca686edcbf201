"""Numeric column expressions: exact rounding, guards, number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.binding import bind
from rubrica.functions.text import strip

ASCII_SPACE = " \t\n\v\f\r"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"


def _nearest4(v: Column) -> Column:
    """Exact decision next to a tie: the double is split into two halves whose products with
    10,000 are exact, so the sign of the distance to the tie is exact too."""
    down = F.floor(v * F.lit(1e4)).cast("double")
    split = v * F.lit(134217729.0)
    high = split - (split - v)
    low = v - high
    over = ((high * F.lit(1e4) - down) - F.lit(0.5)) + low * F.lit(1e4)
    up = (over > 0) | ((over == 0) & (down % 2 != 0))
    return (down + F.when(up, 1.0).otherwise(0.0)) / F.lit(1e4)


def round4(x: Column) -> Column:
    """Round to 4 decimals the way Python's ``round(x, 4)`` does.

    Spark's ``round`` works on the shortest decimal text of the double and rounds half up;
    Python, and so every published score, rounds the exact binary value, ties to even.
    """

    def rounded(v: Column) -> Column:
        scaled = v * F.lit(1e4)
        far = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > 1e-6
        return F.when(far, F.floor(scaled + F.lit(0.5)) / F.lit(1e4)).otherwise(_nearest4(v))

    return bind(x, rounded)


def safe_value(x: Column) -> Column:
    """Null, NaN and infinite feature values count as 0 (NaN compares above infinity)."""
    v = x.cast("double")
    return F.when(F.abs(v) < float("inf"), v).otherwise(0.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def parse_number(text: Column) -> Column:
    """Text to double; null where the text is no plain decimal number.  ASCII white space around it is skipped.

    The pattern guards the cast, which would also take type suffixes such as ``1d``.
    """
    return bind(F.trim(text.cast("string"), F.lit(ASCII_SPACE)), _number)


def _number(t: Column) -> Column:
    infinite = F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike(INFINITE), infinite)


def parse_label(text: Column) -> Column:
    """Rubric label: the number truncated toward zero; null where missing or not finite.  Any white space around
    it is skipped."""
    number = bind(strip(text.cast("string")), _number)
    return bind(number, lambda x: F.when(F.abs(x) < 2147483648.0, x)).cast("int")
