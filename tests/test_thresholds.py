import itertools
import random

import pytest
from pyspark.sql import functions as F

from rubrica.config import ThresholdSearchConfig
from rubrica.operators import thresholds as th
from test_metrics import kappa


def table(spark, rows):
    return spark.createDataFrame(rows, "raw double, y int")


def noisy(n, labels, seed=1):
    rng = random.Random(seed)
    return [(round(min(1.0, max(0.0, 0.17 * y + rng.uniform(0, 0.3))), 4), y) for y in (rng.choice(labels) for _ in range(n))]


def classify(raw, cuts):
    return sum(raw >= c for c in cuts)


def qwk(rows, cuts):
    return kappa([y for _, y in rows], [classify(x, cuts) for x, _ in rows])


@pytest.mark.parametrize("labels", [[0, 1, 2, 3, 4], [0, 2, 4], [1, 3]])
def test_grid_equals_brute_force(spark, labels):
    cfg = ThresholdSearchConfig(grid_step=0.2)
    rows = noisy(150, labels)
    running = th.running_counts(th.score_histogram(table(spark, rows), "raw", "y"))
    scored = {tuple(r[t] for t in th.CUTS): r.qwk for r in th.score_candidates(running, cfg).collect()}
    axes = [[b for b in range(round(lo * 10000), round(hi * 10000) + 1, 2000)] for lo, hi in cfg.bounds]
    wanted = {c for c in itertools.product(*axes) if c[0] < c[1] < c[2] < c[3]} | {(2000, 4000, 6000, 8500)}
    assert set(scored) == wanted
    for cuts, value in scored.items():
        expected = qwk(rows, [c / 10000 for c in cuts])
        assert (value is None) == (expected is None)
        assert value is None or abs(value - expected) < 1e-12


@pytest.mark.parametrize(
    "labels, seed", [([0, 1, 2, 3, 4], 3), ([0, 1, 3, 4], 5), ([0, 2, 4], 4)]
)
def test_fit_is_the_best_of_all_cuts(spark, labels, seed):
    """Few distinct scores: cuts between the same neighbours are alike, so a full search is possible."""
    rng = random.Random(seed)
    scores = sorted(rng.sample(range(500, 9900), 9))
    rows = [(rng.choice(scores) / 10000, rng.choice(labels)) for _ in range(60)]
    cfg = ThresholdSearchConfig()
    cuts, value = th.fit_thresholds(table(spark, rows), "raw", "y", cfg)
    assert all(a < b for a, b in zip(cuts, cuts[1:]))
    assert all(lo <= c <= hi for c, (lo, hi) in zip(cuts, cfg.bounds))
    edges = {s + 1 for s in scores} | {round(x * 10000) for pair in cfg.bounds for x in pair}
    near = sorted({b + k for b in edges for k in range(4) if b + k <= 10000} | {0, 1, 2, 3, 9997, 9998, 9999})
    axes = [[b for b in near if round(lo * 10000) <= b <= round(hi * 10000)] for lo, hi in cfg.bounds]
    best, least, seen = None, None, {}
    for c in itertools.product(*axes):
        if c[0] < c[1] < c[2] < c[3]:
            sides = tuple(sum(s < b for s in scores) for b in c)
            if sides not in seen:
                seen[sides] = qwk(rows, [b / 10000 for b in c])
                if seen[sides] is not None and (best is None or seen[sides] > best + 1e-12):
                    best = seen[sides]
    assert abs(value - best) < 1e-12
    assert abs(value - qwk(rows, cuts)) < 1e-12


def test_fit_on_many_scores(spark):
    rows = noisy(400, [0, 1, 2, 3, 4], seed=3)
    cfg = ThresholdSearchConfig()
    cuts, value = th.fit_thresholds(table(spark, rows), "raw", "y", cfg)
    assert abs(value - qwk(rows, cuts)) < 1e-12 and value >= qwk(rows, cfg.initial)
    rng = random.Random(8)
    for _ in range(3000):  # no move of any cuts is better
        moved = sorted(min(1.0, max(0.0, c + rng.choice([0, 0, rng.gauss(0, 0.01), rng.gauss(0, 0.1)]))) for c in cuts)
        moved = [round(c, 4) for c in moved]
        if all(x < y for x, y in zip(moved, moved[1:])) and all(lo <= c <= hi for c, (lo, hi) in zip(moved, cfg.bounds)):
            assert qwk(rows, moved) <= value + 1e-12
    compared = {r.stage: r for r in th.compare_thresholds(table(spark, rows), "raw", "y", cuts).collect()}
    assert compared["optimized"].qwk == round(value, 4) and compared["initial"].qwk <= compared["optimized"].qwk


def test_a_guess_outside_the_bounds_stays_if_better(spark):
    rows = [(0.05, 0), (0.15, 1), (0.25, 2), (0.35, 3), (0.45, 4)] * 3
    cfg = ThresholdSearchConfig(initial=(0.1, 0.2, 0.3, 0.4), bounds=((0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.0)))
    assert th.fit_thresholds(table(spark, rows), "raw", "y", cfg) == ([0.1, 0.2, 0.3, 0.4], 1.0)


def test_fit_does_not_depend_on_partitions(spark):
    df = table(spark, noisy(300, [0, 1, 2, 3, 4], seed=9))
    assert th.fit_thresholds(df.repartition(1), "raw", "y") == th.fit_thresholds(df.repartition(6), "raw", "y")


def test_score_bins_agree_with_comparison(spark):
    rng = random.Random(2)
    values = [k / 10000 for k in range(0, 10001, 3)] + [rng.random() for _ in range(3000)] + [-0.5, 1.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", th.score_bin(F.col("v")).alias("b")).collect():
        v = min(1.0, max(0.0, r.v))
        assert r.b / 10000 <= v and (r.b == 10000 or v < (r.b + 1) / 10000)


def test_no_candidate_has_a_kappa(spark):
    cfg = ThresholdSearchConfig()
    cuts, value = th.fit_thresholds(table(spark, [(0.9999, 4), (1.0, 4)]), "raw", "y", ThresholdSearchConfig(bounds=((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9))))
    assert cuts == list(cfg.initial) and value is None


@pytest.mark.parametrize("rows", [[], [(0.5, 7)], [(0.5, None)]])
def test_bad_fit_rows(spark, rows):
    with pytest.raises(ValueError):
        th.fit_thresholds(table(spark, rows), "raw", "y")


def test_apply_and_evaluate(spark):
    df = table(spark, [(0.5, 2), (-0.1, 0), (1.7, 4), (0.6, 3)])
    assert [r.pred for r in th.apply_thresholds(df, "raw", [0.2, 0.4, 0.6, 0.85]).collect()] == [2, 0, 4, 3]
    assert [r.pred for r in th.apply_thresholds(df, "raw", [0.0, 0.4, 0.6, 0.85]).collect()] == [2, 1, 4, 3]
    assert th.evaluate_thresholds(df, "raw", "y", [0.2, 0.4, 0.6, 0.85]).first().qwk == 1.0
    with pytest.raises(ValueError):
        th.apply_thresholds(df, "raw", [0.4, 0.4, 0.6, 0.85])
