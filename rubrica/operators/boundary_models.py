"""All class boundaries of the ordinal model at once: weighted, L2-penalised logistic fits by Newton steps.

A step is one aggregate over the training table, whatever the number of boundaries: each row enters once per boundary with its
gradient and curvature weights, combined within tasks, and (coefficients + 1) first and second sums per boundary come
back.  The driver solves one small system per boundary.  The loss is the summed one, ``C`` times the weighted
log loss plus half the squared coefficients; the intercept has no penalty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rubrica.functions.ordinal import logistic

TOLERANCE = 1e-11


@dataclass(frozen=True)
class BoundaryModel:
    """``P(y > boundary) = logistic(coefficients . x + intercept)``."""

    coefficients: DenseVector
    intercept: float


def balance(sizes: dict[int, int], boundary: int) -> tuple[float, float]:
    """Weights of rows above the boundary and of the others: both sides count alike."""
    n, above = sum(sizes.values()), sum(size for label, size in sizes.items() if label > boundary)
    return n / (2.0 * above), n / (2.0 * (n - above))


def _weighted(names: Sequence[str], boundary: int, beta: Sequence[float], sides: tuple[float, float]) -> Column:
    """A row's weights in the gradient (``d``), the curvature (``s``) and the loss (``l``) of one boundary."""
    score = F.lit(float(beta[-1]))
    for name, value in zip(names, beta):
        score = score + F.col(name) * F.lit(float(value))
    above = F.col("_label") > boundary
    weight = F.col("n").cast("double") * F.when(above, F.lit(sides[0])).otherwise(F.lit(sides[1]))
    p, y = logistic(score), above.cast("double")
    loss = F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - y * score
    return F.struct(
        F.lit(boundary).alias("boundary"),
        (weight * (p - y)).alias("d"),
        (weight * p * (F.lit(1.0) - p)).alias("s"),
        (weight * loss).alias("l"),
    )


def step_sums(
    table: DataFrame, names: Sequence[str], betas: dict[int, Sequence[float]], sides: dict[int, tuple[float, float]]
) -> DataFrame:
    """One row per boundary: first sums ``g0`` .. , second sums ``h0_0`` .. (the intercept is the last place), ``loss``.

    ``table`` has the inputs ``names``, ``_label`` and the multiplicity ``n`` of each row.
    """
    rows = F.array(*[_weighted(names, b, beta, sides[b]) for b, beta in betas.items()])
    each = table.select(*names, F.inline(rows))
    inputs = [*(F.col(n) for n in names), F.lit(1.0)]
    first = [F.sum(F.col("d") * x).alias(f"g{i}") for i, x in enumerate(inputs)]
    places = combinations_with_replacement(range(len(inputs)), 2)
    second = [F.sum(F.col("s") * inputs[i] * inputs[j]).alias(f"h{i}_{j}") for i, j in places]
    return each.groupBy("boundary").agg(*first, *second, F.sum("l").alias("loss"))


def _newton(row: Row, beta: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """The step from ``beta``, and the whole loss there."""
    size = len(beta)
    penalty = np.array([1.0] * (size - 1) + [0.0])
    gradient = c * np.array([row[f"g{i}"] for i in range(size)]) + penalty * beta
    curvature = c * np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    step = np.linalg.lstsq(curvature + np.diag(penalty), gradient, rcond=None)[0]
    return step, c * row["loss"] + 0.5 * float((penalty * beta) @ beta)


def fit_boundaries(
    table: DataFrame, names: Sequence[str], sizes: dict[int, int], c: float, max_iter: int
) -> tuple[BoundaryModel, ...]:
    """Models of ``_label > class`` for every class in ``sizes`` but the last.

    A boundary whose loss rose goes half the way back; one whose steps have become tiny leaves.
    """
    boundaries = sorted(sizes)[:-1]
    sides = {b: balance(sizes, b) for b in boundaries}
    betas = {b: np.zeros(len(names) + 1) for b in boundaries}
    best: dict[int, tuple[np.ndarray, float]] = {}
    going = set(boundaries)
    for _ in range(max_iter):
        if not going:
            break
        sums = step_sums(table, names, {b: betas[b] for b in sorted(going)}, sides)
        for row in sums.collect():  # one row per boundary
            b = row["boundary"]
            step, loss = _newton(row, betas[b], c)
            if b in best and loss > best[b][1] * (1 + 1e-12):
                betas[b] = (best[b][0] + betas[b]) / 2
                if np.abs(betas[b] - best[b][0]).max() < TOLERANCE:
                    going.discard(b)
                continue
            best[b] = (betas[b], loss)
            betas[b] = betas[b] - step
            if np.abs(step).max() < TOLERANCE * (1 + np.abs(betas[b]).max()):
                going.discard(b)
    return tuple(BoundaryModel(DenseVector(betas[b][:-1]), float(betas[b][-1])) for b in boundaries)
