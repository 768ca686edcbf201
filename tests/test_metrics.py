import random

import numpy as np
import pytest

from rubrica.operators import metrics, profile


def frame(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "y int, p int")


def kappa(truth, pred):
    """Weighted kappa from the matrix of weights, labels indexed by their sorted union."""
    labels = sorted(set(truth) | set(pred))
    place = {label: i for i, label in enumerate(labels)}
    o = np.zeros((len(labels),) * 2)
    for t, p in zip(truth, pred):
        o[place[t], place[p]] += 1
    w = np.subtract.outer(np.arange(len(labels)), np.arange(len(labels))) ** 2
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return None if (w * e).sum() == 0 else 1 - (w * o).sum() / (w * e).sum()


def f1(truth, pred):
    labels = sorted(set(truth) | set(pred))
    total = 0.0
    for label in labels:
        tp = sum(t == p == label for t, p in zip(truth, pred))
        total += 2 * tp / (truth.count(label) + pred.count(label))
    return total / len(labels)


CASES = [([0, 0, 4, 4], [0, 4, 4, 4]), ([4, 4, 4], [4, 4, 4]), ([1, 3, 1], [3, 1, 1]), ([0, 1, 2, 3, 4], [0, 1, 2, 3, 4]), ([2, 2], [1, 1])]


def random_cases():
    rng = random.Random(5)
    return [([rng.choice(pool) for _ in range(60)], [rng.choice(pool) for _ in range(60)]) for pool in ([0, 1, 2, 3, 4], [0, 2, 4], [1, 7], [3, 4, 4, 4, 4])]


@pytest.mark.parametrize("truth, pred", CASES + random_cases())
def test_evaluate(spark, truth, pred):
    row = metrics.evaluate(frame(spark, truth, pred), "y", "p").first()
    expected = kappa(truth, pred)
    assert row.n == len(truth)
    assert row.qwk is None if expected is None else abs(row.qwk - expected) < 5.1e-5
    assert abs(row.accuracy - sum(t == p for t, p in zip(truth, pred)) / len(truth)) < 5.1e-5
    assert abs(row.macro_f1 - f1(truth, pred)) < 5.1e-5


def test_golden_kappa(spark):
    assert metrics.evaluate(frame(spark, *CASES[0]), "y", "p").first().qwk == 0.5
    assert metrics.evaluate(frame(spark, *CASES[1]), "y", "p").first().qwk is None


def test_rows_without_truth_or_prediction_are_left_out(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (2, None), (0, 1)], "y int, p int")
    assert metrics.evaluate(df, "y", "p").first().n == 2
    assert sum(r.n for r in metrics.error_profile(df, "y", "p").collect()) == 2


def test_matrix_and_profile(spark):
    df = frame(spark, [0, 0, 4, 4, 1], [0, 4, 4, 4, 3])
    matrix = {r.truth: list(r)[1:] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert matrix == {0: [1, 0, 0, 0, 1], 1: [0, 0, 0, 1, 0], 2: [0] * 5, 3: [0] * 5, 4: [0, 0, 0, 0, 2]}
    assert {r.off_by: r.n for r in metrics.error_profile(df, "y", "p").collect()} == {0: 3, 4: 1, 2: 1}


def test_classification_report(spark):
    report = {r.label: r for r in metrics.classification_report(frame(spark, [0, 0, 4, 4, 1], [0, 4, 4, 4, 3]), "y", "p").collect()}
    assert (report["0"].precision, report["0"].recall, report["0"].f1, report["0"].support) == (1.0, 0.5, 0.6667, 2)
    assert (report["2"].precision, report["2"].support) == (0.0, 0)
    assert report["accuracy"].f1 == 0.6 and report["accuracy"].precision is None
    assert report["macro avg"].f1 == round((2 / 3 + 0.8) / 5, 4) and report["macro avg"].support == 5
    assert report["weighted avg"].recall == 0.6


def test_profiles(spark):
    df = spark.createDataFrame([(4,), (4,), (0,), (None,)], "human_score int")
    assert {r.human_score: (r.n, r.percent) for r in profile.label_distribution(df).collect()} == {4: (2, 66.6667), 0: (1, 33.3333)}
    pairs = spark.createDataFrame([("¡Hola!", "hola"), ("a b", "A, b."), ("a", None)], "stimulus string, transcription string")
    assert profile.exact_match_profile(pairs).first().asDict() == {"total": 3, "exact": 1, "needs_features": 2, "exact_percent": 33.3333}
    assert profile.exact_match_profile(pairs.limit(0)).first().exact_percent is None


def test_metrics_need_one_shuffle_of_the_data(spark, plan_of):
    plan = plan_of(metrics.evaluate(frame(spark, [0, 1], [1, 1]), "y", "p"))
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
