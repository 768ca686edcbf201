"""Agreement metrics as column expressions over the cells of a confusion matrix.

``cells`` is an array of ``struct<t, p, n>``: truth, prediction and count.  It has at most one
entry per pair of labels, so every expression here works on a handful of values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.binding import bind
from rubrica.functions.numeric import round4


def _labels(cells: Column) -> Column:
    truth, pred = (F.transform(cells, lambda c: c[k]) for k in ("t", "p"))
    return F.array_sort(F.array_distinct(F.concat(truth, pred)))


def _total(cells: Column, weight) -> Column:
    weighted = F.transform(cells, lambda c: weight(c).cast("double"))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def weighted_kappa(cells: Column) -> Column:
    """Quadratic weighted kappa; null where it is 0/0.

    Distances are between positions among the labels that occur as truth or prediction.  With
    squared distances the observed and expected sums follow from five moments, so the matrix
    of weights is never built.
    """

    def place(cell: Column, labels: Column) -> Column:
        return F.struct(
            cell["n"].cast("double").alias("n"),
            (F.array_position(labels, cell["t"]) - 1).alias("i"),
            (F.array_position(labels, cell["p"]) - 1).alias("j"),
        )

    def moments(placed: Column) -> Column:
        return F.struct(
            _total(placed, lambda c: c["n"]).alias("n"),
            _total(placed, lambda c: c["n"] * (c["i"] * c["i"] + c["j"] * c["j"])).alias("squares"),
            _total(placed, lambda c: c["n"] * c["i"] * c["j"]).alias("crossed"),
            _total(placed, lambda c: c["n"] * c["i"]).alias("rows"),
            _total(placed, lambda c: c["n"] * c["j"]).alias("cols"),
        )

    def kappa(m: Column) -> Column:
        expected = m["squares"] - F.lit(2.0) * m["rows"] * (m["cols"] / m["n"])
        observed = m["squares"] - F.lit(2.0) * m["crossed"]
        return F.when(expected != 0, F.lit(1.0) - observed / expected)

    placed = bind(cells, lambda cs: bind(_labels(cs), lambda ls: F.transform(cs, lambda c: place(c, ls))))
    return bind(bind(placed, moments), kappa)


def accuracy(cells: Column) -> Column:
    hits = _total(cells, lambda c: F.when(c["t"] == c["p"], c["n"]).otherwise(0))
    return hits / _total(cells, lambda c: c["n"])


def class_counts(cells: Column, label: Column) -> tuple[Column, Column, Column]:
    """True positives, rows of truth and rows of prediction of one label."""
    is_t, is_p = (lambda c: c["t"] == label), (lambda c: c["p"] == label)
    count = lambda test: _total(cells, lambda c: F.when(test(c), c["n"]).otherwise(0))
    return count(lambda c: is_t(c) & is_p(c)), count(is_t), count(is_p)


def macro_f1(cells: Column) -> Column:
    """Unweighted mean of the F1 of every label that occurs; 0/0 counts 0."""

    def f1(label: Column) -> Column:
        hit, truth, pred = class_counts(cells, label)
        return F.lit(2.0) * hit / (truth + pred)

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)

    return bind(F.transform(_labels(cells), f1), mean)


def metric_columns(cells: Column) -> list[Column]:
    return [
        round4(weighted_kappa(cells)).alias("qwk"),
        round4(accuracy(cells)).alias("accuracy"),
        round4(macro_f1(cells)).alias("macro_f1"),
    ]
