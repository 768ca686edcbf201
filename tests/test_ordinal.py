import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.config import OrdinalConfig
from rubrica.functions.ordinal import class_probabilities, most_likely
from rubrica.operators import ordinal

NAMES = OrdinalConfig.features
SCHEMA = "id int, human_score int, early_gate_score int, " + ", ".join(f"{n} double" for n in NAMES)


def data(spark, labels=(0, 1, 2, 3, 4), n=300, gated=True):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        y = int(rng.choice(labels))
        x = (0.2 * y + rng.normal(0, 0.15, len(NAMES))).round(4).tolist()
        if gated and i % 4 == 0 and y in (0, 4):
            rows.append((i, y, y, *[None] * len(NAMES)))
        else:
            rows.append((i, y, None, *x))
    return spark.createDataFrame(rows, SCHEMA), rows


def gradient(rows, boundary, model, c=1.0):
    """Largest partial derivative of the summed, balanced, L2-penalised logistic loss."""
    x = np.array([[v or 0.0 for v in r[3:]] for r in rows])
    y = np.array([r[1] > boundary for r in rows], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    return max(np.abs(c * x.T @ (w * (p - y)) + model.coefficients.toArray()).max(), abs(c * (w * (p - y)).sum()))


@pytest.mark.parametrize("c", [1.0, 0.1])
def test_logistic_fits_reach_the_optimum(spark, c):
    df, rows = data(spark)
    model = ordinal.fit_ordinal(df, cfg=OrdinalConfig(lr_c=c))
    assert model.classes == (0, 1, 2, 3, 4)
    for boundary, binary in zip(model.classes, model.binary):
        assert gradient(rows, boundary, binary, c) < 1e-8


def test_logistic_fits_equal_a_general_solver(spark):
    """The library's own estimator, one boundary at a time, on the same loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df, rows = data(spark)
    model = ordinal.fit_ordinal(df)
    table = VectorAssembler(inputCols=list(NAMES), outputCol="x").transform(ordinal.training_table(df, "human_score", model.config))
    for boundary, binary in zip(model.classes, model.binary):
        above = sum(r[1] > boundary for r in rows)
        weight = F.when(F.col("_label") > boundary, len(rows) / (2.0 * above)).otherwise(len(rows) / (2.0 * (len(rows) - above)))
        one = table.select("x", (F.col("_label") > boundary).cast("double").alias("y"), (weight * F.col("n")).alias("w"))
        fitted = LogisticRegression(
            featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / len(rows), standardization=False, tol=1e-14, maxIter=2000
        ).fit(one)
        assert np.allclose(fitted.coefficients.toArray(), binary.coefficients.toArray(), atol=1e-4)
        assert abs(fitted.intercept - binary.intercept) < 1e-4


def test_separable_labels_converge(spark):
    rows = [(i, 4 if i % 2 else 0, None, *[float(i % 2)] * len(NAMES)) for i in range(40)]
    model = ordinal.fit_ordinal(spark.createDataFrame(rows, SCHEMA), cfg=OrdinalConfig(lr_c=100.0))
    assert gradient(rows, 0, model.binary[0], 100.0) < 1e-6


def test_one_scan_per_step(spark, plan_of):
    from rubrica.operators.boundary_models import step_sums

    df, _ = data(spark)
    table = ordinal.training_table(df, "human_score", OrdinalConfig(include_gated=False))
    betas = {b: [0.0] * (len(NAMES) + 1) for b in range(4)}
    plan = plan_of(step_sums(table, NAMES, betas, dict.fromkeys(range(4), (1.0, 1.0))))
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 1 and "Python" not in plan


def test_equal_rows_are_one_row_of_each_step(spark, monkeypatch):
    df, rows = data(spark)
    stored, store = [], ordinal.materialize
    monkeypatch.setattr(ordinal, "materialize", lambda df, name: stored.append(store(df, name)) or stored[-1])
    once, many = (ordinal.fit_ordinal(x, cfg=OrdinalConfig(lr_c=c)) for x, c in ((df, 1.0), (df.union(df).union(df), 1 / 3)))
    assert stored[0].count() == stored[1].count()
    assert [x.agg(F.sum("n")).first()[0] for x in stored] == [len(rows), 3 * len(rows)]
    for a, b in zip(once.binary, many.binary):
        assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-9)
        assert abs(a.intercept - b.intercept) < 1e-9


def test_gated_rows_collapse_to_counts(spark):
    df, rows = data(spark)
    table = ordinal.training_table(df, "human_score", OrdinalConfig())
    gated = sum(r[2] is not None for r in rows)
    assert table.count() == len(rows) - gated + 2 and table.agg(F.sum("n")).first()[0] == len(rows)
    forest = ordinal.training_table(df, "human_score", OrdinalConfig(model_type="random_forest"))
    assert forest.count() == len(rows)
    without = ordinal.training_table(df, "human_score", OrdinalConfig(include_gated=False))
    assert without.count() == len(rows) - gated


def test_predictions_and_probabilities(spark):
    df, rows = data(spark)
    model = ordinal.fit_ordinal(df)
    scored = model.predict_proba(model.score(df)).collect()
    for r in scored:
        probs = [r[f"prob_{c}"] for c in range(5)]
        assert abs(sum(probs) - 1) < 5e-4 and all(0 <= p <= 1 for p in probs)
        assert r.ordinal_pred == r.early_gate_score if r.early_gate_score is not None else r.ordinal_pred in range(5)
        if r.early_gate_score is None:
            assert probs[r.ordinal_pred] >= max(probs) - 1e-4
    assert model.evaluate(df).first().qwk > 0.7


def test_details(spark):
    df, _ = data(spark)
    details = {r.id: (r.early_gate_score, r.details) for r in ordinal.fit_ordinal(df).details(df).collect()}
    for gate, d in details.values():
        assert list(d.feature_names) == list(NAMES) and set(d.input_features) == set(NAMES)
        if gate is None:
            assert d.reason is None and set(d.probabilities) == {f"prob_{c}" for c in range(5)}
        else:
            assert d.reason == "early_gate_override" and d.probabilities is None and d.predicted_score == gate


def test_absent_class_has_probability_zero(spark):
    df, _ = data(spark, labels=(0, 3, 4))
    model = ordinal.fit_ordinal(df)
    assert model.classes == (0, 3, 4) and len(model.binary) == 2
    row = model.predict_proba(df).first()
    assert row.prob_1 == row.prob_2 == 0 and set(r.ordinal_pred for r in model.score(df).collect()) <= {0, 3, 4}
    assert {r.binary_task for r in model.summary(df).collect()} == {"y > 0", "y > 3"}


def test_forest(spark):
    df, _ = data(spark)
    model = ordinal.fit_ordinal(df, cfg=OrdinalConfig(model_type="random_forest", rf_trees=10))
    assert model.evaluate(df).first().qwk > 0.7
    importances = model.summary(df).groupBy("binary_task").agg(F.sum("value").alias("s")).collect()
    assert len(importances) == 4 and all(abs(r.s - 1) < 1e-3 for r in importances)
    assert set(model.score(df).columns) == {*df.columns, "ordinal_pred"}


@pytest.mark.parametrize("labels", [(4,), (0, 9)])
def test_bad_training_labels(spark, labels):
    df, _ = data(spark, labels=labels, n=30)
    with pytest.raises(ValueError):
        ordinal.fit_ordinal(df)
    with pytest.raises(ValueError):
        ordinal.fit_ordinal(df.limit(0))


def test_class_recovery(spark):
    cases = [
        ((0.9, 0.75, 0.25, 0.1), (0.1, 0.15, 0.5, 0.15, 0.1), 2),
        ((1.0, 0.75, 0.5, 0.25), (0.0, 0.25, 0.25, 0.25, 0.25), 1),
        ((0.2, 0.5, 0.1, 0.1), (0.8 / 1.3, 0.0, 0.4 / 1.3, 0.0, 0.1 / 1.3), 0),
    ]
    df = spark.createDataFrame([(i, *g) for i, (g, _, _) in enumerate(cases)], "i int, a double, b double, c double, d double")
    p = class_probabilities([F.col(x) for x in "abcd"])
    got = df.withColumn("p", p).select("p", most_likely(F.col("p"), range(5)).alias("k"), "i").orderBy("i").collect()
    for r, (_, probs, k) in zip(got, cases):
        assert r.k == k and np.allclose(r.p, probs)


def test_logistic_scoring_is_a_projection(spark, plan_of):
    df, _ = data(spark)
    model = ordinal.fit_ordinal(df)
    plan = plan_of(model.score(df))
    assert "UDF" not in plan and "Exchange" not in plan
