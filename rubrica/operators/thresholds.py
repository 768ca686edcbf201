"""Cut points that maximise quadratic weighted kappa.

The data are read once, into counts per (score bin, label): raw scores have 4 decimals, so there
are at most 10,001 bins.  Running counts below each bin then give every confusion matrix a
candidate needs, and candidates are rows of a DataFrame.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.config import RUBRIC, ThresholdSearchConfig, check_cuts
from rubrica.functions.agreement import weighted_kappa
from rubrica.functions.binding import bind
from rubrica.functions.numeric import clamp01
from rubrica.operators.heuristic import to_rubric
from rubrica.operators.metrics import evaluate
from rubrica.operators.optimal_cuts import best_cuts
from rubrica.session import materialize

SCALE = 10_000
CUTS = ("t1", "t2", "t3", "t4")


def check_fit_rows(df: DataFrame, label: str) -> None:
    """Raises unless there are rows and every label is a rubric grade."""
    bad = F.col(label).isNull() | ~F.col(label).isin(*RUBRIC)
    n, invalid = df.agg(F.count("*"), F.count_if(bad)).first()
    if n == 0:
        raise ValueError("no rows to fit cut points on")
    if invalid:
        raise ValueError("labels must be grades 0 to 4")


def score_bin(raw: Column) -> Column:
    """Largest k with k / 10000 <= raw, so ``raw < t`` is ``bin < t * 10000`` for 4-decimal cuts."""
    clamped = clamp01(raw.cast("double"))
    near = F.round(clamped * SCALE).cast("int")
    return near - (near / F.lit(float(SCALE)) > clamped).cast("int")


def score_histogram(df: DataFrame, raw: str, label: str) -> DataFrame:
    """Counts per (score bin, label): the only pass over the data."""
    return df.groupBy(score_bin(F.col(raw)).alias("bin"), F.col(label).cast("int").alias("label")).agg(
        F.count("*").alias("n")
    )


def running_counts(histogram: DataFrame) -> DataFrame:
    """Per cut value ``bin`` (0 to 10,000) the rows of each label ``below`` it, and the ``total``
    of each label: arrays in label order."""
    wide = histogram.groupBy("bin").agg(
        *[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"b{y}") for y in RUBRIC]
    )
    bins = histogram.sparkSession.range(SCALE + 1).select(F.col("id").cast("int").alias("bin"))
    dense = bins.join(F.broadcast(wide), "bin", "left").fillna(0)
    # At most 10,001 rows, whatever the size of the data.
    before = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    return dense.select(
        "bin",
        F.array(*[F.coalesce(F.sum(f"b{y}").over(before), F.lit(0)) for y in RUBRIC]).alias("below"),
        F.array(*[F.sum(f"b{y}").over(whole) for y in RUBRIC]).alias("total"),
    )


def _kappa(below: Sequence[Column], total: Column) -> Column:
    """QWK from the counts of each label below each of the four cuts.

    Label y gets grade p as often as it lies between cut p and cut p + 1.
    """
    edges = [F.transform(total, lambda _: F.lit(0).cast("long")), *below, total]

    def cells_of(steps: Column) -> Column:
        def cell(y: Column, p: Column) -> Column:
            return F.struct(y.alias("t"), p.alias("p"), (steps[p + 1][y] - steps[p][y]).alias("n"))

        labels = F.array(*[F.lit(y) for y in RUBRIC])
        return F.flatten(F.transform(labels, lambda y: F.transform(labels, lambda p: cell(y, p))))

    return weighted_kappa(F.filter(bind(F.array(*edges), cells_of), lambda c: c["n"] > 0))


def _bins(low: float, high: float, step: float) -> list[int]:
    first, last, width = (round(x * SCALE) for x in (low, high, step))
    if width < 1:
        raise ValueError(f"grid_step must be {1 / SCALE} or more")
    return sorted({*range(first, last + 1, width)})


def grid_candidates(cfg: ThresholdSearchConfig) -> list[tuple[int, ...]]:
    """Strictly increasing combinations of grid cuts inside the bounds, and the initial guess.

    A set of parameters: its size depends on the settings, not on the data.
    """
    axes = [_bins(low, high, cfg.grid_step) for low, high in cfg.bounds]
    rising = {c for c in itertools.product(*axes) if all(a < b for a, b in zip(c, c[1:]))}
    return sorted(rising | {tuple(round(t * SCALE) for t in cfg.initial)})


def score_candidates(running: DataFrame, cfg: ThresholdSearchConfig) -> DataFrame:
    """Grid cuts with their ``qwk``."""
    return score_cuts(running, grid_candidates(cfg))


def score_cuts(running: DataFrame, candidates: Sequence[tuple[int, ...]]) -> DataFrame:
    """Given cuts (as bins ``t1`` to ``t4``) with their ``qwk``; null where it is 0/0."""
    out = running.sparkSession.createDataFrame(candidates, ", ".join(f"{t} int" for t in CUTS))
    at_cut = running.filter(F.col("bin").isin(sorted({b for cuts in candidates for b in cuts})))
    for cut in CUTS:
        total = ["total"] if cut == CUTS[0] else []
        counts = at_cut.select(F.col("bin").alias(cut), F.col("below").alias(f"below_{cut}"), *total)
        out = out.join(F.broadcast(counts), cut)  # one row per grid value
    return out.select(*CUTS, _kappa([F.col(f"below_{t}") for t in CUTS], F.col("total")).alias("qwk"))


def best_candidate(scored: DataFrame) -> DataFrame:
    """Highest QWK; ties go to the smallest cuts."""
    rank = F.struct(F.col("qwk"), *[(-F.col(t)).alias(t) for t in CUTS])
    best = scored.filter(F.col("qwk").isNotNull()).agg(F.max(rank).alias("best"))
    return best.select(
        *[(-F.col(f"best.{t}") / F.lit(float(SCALE))).alias(t) for t in CUTS], F.col("best.qwk").alias("qwk")
    )


def fit_thresholds(
    df: DataFrame, raw: str, label: str, cfg: ThresholdSearchConfig = ThresholdSearchConfig()
) -> tuple[list[float], float | None]:
    """The best 4-decimal cut points inside the bounds, and their QWK.

    An initial guess outside the bounds is kept if it is better still; where no cuts have a QWK it comes back.
    """
    check_fit_rows(df, label)
    running = materialize(running_counts(score_histogram(df, raw, label)), "running-counts")
    found = best_cuts(running, cfg, SCALE)
    initial = [round(t * SCALE) for t in cfg.initial]
    inside = all(low <= t <= high for t, (low, high) in zip(cfg.initial, cfg.bounds))
    if found is None or not inside:
        guess = score_cuts(running, [tuple(initial)]).first()["qwk"]
        if found is None or (guess is not None and guess > found[1]):
            return list(cfg.initial), guess
    cuts, qwk = found
    return [b / SCALE for b in cuts], qwk


def apply_thresholds(df: DataFrame, raw: str, cuts: Sequence[float], name: str = "pred") -> DataFrame:
    """Classes of raw scores, clipped to [0, 1] first."""
    checked = check_cuts(list(cuts), "prediction thresholds")
    return df.withColumn(name, to_rubric(clamp01(F.col(raw)), checked))


def evaluate_thresholds(df: DataFrame, raw: str, label: str, cuts: Sequence[float]) -> DataFrame:
    return evaluate(apply_thresholds(df, raw, cuts, "_pred"), label, "_pred")


def compare_thresholds(
    df: DataFrame, raw: str, label: str, fitted: Sequence[float], cfg: ThresholdSearchConfig = ThresholdSearchConfig()
) -> DataFrame:
    """Metrics of the initial guess and of the fitted cuts."""
    sets = {"initial": cfg.initial, "optimized": fitted}
    wide = df.select(
        label,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("stage"), to_rubric(clamp01(F.col(raw)), cuts).alias("pred"))
                    for name, cuts in sets.items()
                ]
            )
        ).alias("x"),
    ).select(label, "x.*")
    return evaluate(wide, label, "pred", by=["stage"])
