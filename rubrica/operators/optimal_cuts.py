"""The best cut points of all: a ratio of two sums, minimised by shortest paths over the score bins.

Kappa is 1 - observed / expected disagreement.  With the labels fixed, both are sums over the rows of a grade's segment
of scores, so for a given ratio ``mu`` the cuts that minimise ``observed - mu * expected`` are a shortest path: one window of
running minima per cut over the at most 10,001 bins.  Starting from ``mu`` = 0 each round takes the ratio of the cuts found as the
next ``mu``; the ratio falls until no cuts are better, after a handful of rounds.  A round is one job on the stored running
counts.

Distances count places among the grades in use, so every set of grades that may be in use is searched by itself: its grades
without labels must get rows, grades outside it must get none.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rubrica.config import RUBRIC, ThresholdSearchConfig

ANY, SOME, NONE = "any number of rows", "at least one row", "no row"


def _segment_sums(running: DataFrame, used: Sequence[int]) -> DataFrame:
    """Per bin, for every grade: disagreement of the rows below it if they all got that grade, observed (``o``) and expected
    (``d``, times the number of rows); ``end`` marks the place behind the last row."""
    place = {grade: i for i, grade in enumerate(used)}

    def disagreement(counts: Column, grade: int) -> Column:
        return sum((counts[y] * (place[y] - place.get(grade, 0)) ** 2 for y in used), F.lit(0).cast("bigint"))

    def columns(counts: Column) -> list[Column]:
        rows = sum((counts[y] for y in RUBRIC), F.lit(0).cast("bigint"))
        out = [rows.alias("n")]
        for grade in RUBRIC:
            out.append(disagreement(counts, grade).cast("double").alias(f"o{grade}"))
            apart = disagreement(F.col("total"), grade).cast("double")
            out.append((rows.cast("double") * apart).alias(f"d{grade}"))
        return out

    return running.select(
        "bin", *columns(F.col("below")), F.struct(*columns(F.col("total"))).alias("end")
    )


def _state(cost: Column, cuts: list[Column], observed: Column, expected: Column) -> Column:
    """A path; the cheapest one, then that with the smallest cuts, is the least."""
    named = [c.alias(f"t{i + 1}") for i, c in enumerate(cuts)]
    return F.struct(cost.alias("cost"), *named, observed.alias("o"), expected.alias("d"))


def _cheapest(sums: DataFrame, rules: Sequence[str], mu: float, cfg: ThresholdSearchConfig, scale: int) -> Row | None:
    """The cuts with the least ``observed - mu * expected``: t1 to t4, o, d."""
    whole = Window.partitionBy(F.lit(0))
    before = {
        ANY: whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1),
        SOME: whole.orderBy("n").rangeBetween(Window.unboundedPreceding, -1),
        NONE: Window.partitionBy("n").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1),
    }
    allowed = {ANY: lambda n, m: F.lit(True), SOME: lambda n, m: n < m, NONE: lambda n, m: n == m}
    limits = [(round(low * scale), round(high * scale)) for low, high in cfg.bounds]

    def weight(grade: int, at: str = "") -> Column:
        return F.col(f"{at}o{grade}") - F.lit(mu) * F.col(f"{at}d{grade}")

    fits = allowed[rules[0]](F.lit(0), F.col("n")) & F.col("bin").between(*limits[0])
    path = F.when(fits, _state(weight(0), [F.col("bin")], F.col("o0"), F.col("d0")))
    table = sums.withColumn("path", path)
    for i in range(1, len(limits)):
        cuts = [F.col(f"path.t{k}") for k in range(1, i + 1)]
        left = _state(F.col("path.cost") - weight(i), cuts, F.col("path.o") - F.col(f"o{i}"), F.col("path.d") - F.col(f"d{i}"))
        table = table.withColumn("left", F.when(F.col("path").isNotNull(), left))
        table = table.withColumn("left", F.min("left").over(before[rules[i]]))
        cuts = [*(F.col(f"left.t{k}") for k in range(1, i + 1)), F.col("bin")]
        path = _state(F.col("left.cost") + weight(i), cuts, F.col("left.o") + F.col(f"o{i}"), F.col("left.d") + F.col(f"d{i}"))
        fits = F.col("left").isNotNull() & F.col("bin").between(*limits[i])
        table = table.withColumn("path", F.when(fits, path))
    last = len(limits)
    cost = F.col("path.cost") - weight(last) + weight(last, "end.")
    totals = (F.col(f"path.{x}") - F.col(f"{x}{last}") + F.col(f"end.{x}{last}") for x in "od")
    whole_path = _state(cost, [F.col(f"path.t{k}") for k in range(1, last + 1)], *totals)
    ends = table.filter(F.col("path").isNotNull() & allowed[rules[last]](F.col("n"), F.col("end.n")))
    return ends.agg(F.min(whole_path).alias("best")).first()["best"]


def _best_of_set(running: DataFrame, used: Sequence[int], labels: set[int], cfg, scale: int) -> Row | None:
    rules = [NONE if g not in used else ANY if g in labels else SOME for g in RUBRIC]
    sums = _segment_sums(running, used)
    mu, best = 0.0, None
    for _ in range(cfg.maxiter):
        found = _cheapest(sums, rules, mu, cfg, scale)
        if found is None:
            return None
        ratio = found["o"] / found["d"]
        if best is not None and ratio >= mu:
            return found if ratio == mu else best
        mu, best = ratio, found
    return best


def best_cuts(running: DataFrame, cfg: ThresholdSearchConfig, scale: int) -> tuple[list[int], float] | None:
    """Bins of the cuts with the highest kappa inside the bounds, and that kappa; ties go to the smallest cuts.

    None where no increasing cuts inside the bounds have a kappa.
    """
    total = running.select("total").first()
    labels = {g for g in RUBRIC if total is not None and total["total"][g]}
    rows = sum(total["total"]) if labels else 0
    others = [g for g in RUBRIC if g not in labels]
    found = []
    for k in range(len(others) + 1):
        for more in itertools.combinations(others, k):
            used = sorted(labels | set(more))
            if len(used) > 1:
                best = _best_of_set(running, used, labels, cfg, scale)
                if best is not None:
                    cuts = [best[f"t{i}"] for i in range(1, len(cfg.bounds) + 1)]
                    found.append((rows * (best["o"] / best["d"]), cuts))
    if not found:
        return None
    lost, cuts = min(found)
    return cuts, 1.0 - lost
