"""Approach B: an ordinal classifier made of K-1 binary models, one per class boundary."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import RUBRIC, OrdinalConfig
from rubrica.functions.numeric import round4, safe_value
from rubrica.functions.ordinal import class_probabilities, logistic, most_likely
from rubrica.operators.boundary_models import BoundaryModel, fit_boundaries
from rubrica.operators.metrics import evaluate
from rubrica.session import materialize

ROWS_PER_TASK = 65_536

BinaryModel = BoundaryModel | RandomForestClassificationModel


def _inputs(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Feature columns in fixed order; missing, NaN and infinite values are 0."""
    return [(safe_value(F.col(n)) if n in df.columns else F.lit(0.0)).alias(n) for n in names]


@dataclass(frozen=True)
class OrdinalModel:
    """Fitted binary models of ``y > classes[i]`` with the classes they separate."""

    config: OrdinalConfig
    classes: tuple[int, ...]
    binary: tuple[BinaryModel, ...]

    def _with_greater(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """Add ``P(y > class)`` per boundary.

        Logistic models are plain arithmetic on the features, so they are written as columns;
        forests go through their own transformer.
        """
        names = [f"_g{i}" for i in range(len(self.binary))]
        inputs = _inputs(df, self.config.features)
        if self.config.model_type != "random_forest":
            columns = {}
            for name, model in zip(names, self.binary):
                score = F.lit(float(model.intercept))
                for value, weight in zip(inputs, model.coefficients.toArray()):
                    score = score + value * F.lit(float(weight))
                columns[name] = logistic(score)
            return df.withColumns(columns), names
        out = df.withColumns({f"_x{i}": value for i, value in enumerate(inputs)})
        assembled = [f"_x{i}" for i in range(len(inputs))]
        out = VectorAssembler(inputCols=assembled, outputCol="_features").transform(out)
        for name, model in zip(names, self.binary):
            stage = model.copy()
            stage.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
            out = stage.transform(out).withColumn(name, vector_to_array("_p")[1]).drop("_p", "_r", "_c")
        return out.drop("_features", *assembled), names

    def with_probabilities(self, df: DataFrame) -> DataFrame:
        """Add ``_probabilities`` (one per fitted class)."""
        out, names = self._with_greater(df)
        return out.withColumn("_probabilities", class_probabilities([F.col(n) for n in names])).drop(*names)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``prob_0`` to ``prob_4`` by class value, 4 decimals; an unseen class has 0."""
        out = self.with_probabilities(df)
        columns = {
            f"prob_{c}": round4(F.col("_probabilities")[self.classes.index(c)]) if c in self.classes else F.lit(0.0)
            for c in RUBRIC
        }
        return out.withColumns(columns).drop("_probabilities")

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``ordinal_pred``; a gate score overrides the model."""
        out = self.with_probabilities(df)
        predicted = most_likely(F.col("_probabilities"), self.classes)
        gate = F.col("early_gate_score") if "early_gate_score" in df.columns else F.lit(None)
        final = F.when(gate.isin(0, 4), gate).otherwise(predicted)
        return out.withColumn("ordinal_pred", final.cast("int")).drop("_probabilities")

    def details(self, df: DataFrame) -> DataFrame:
        """Add ``details``: prediction, reason, probabilities and inputs of each row."""
        probs = [f"prob_{c}" for c in RUBRIC]
        out = self.predict_proba(self.score(df))
        gate = F.col("early_gate_score") if "early_gate_score" in df.columns else F.lit(None)
        settled = F.coalesce(gate.isin(0, 4), F.lit(False))

        def as_map(items: list[tuple[str, Column]]) -> Column:
            return F.create_map(*[x for name, value in items for x in (F.lit(name), value)])

        inputs = [(n, F.col(n).cast("double") if n in df.columns else F.lit(None).cast("double")) for n in self.config.features]
        record = F.struct(
            F.col("ordinal_pred").alias("predicted_score"),
            F.when(settled, "early_gate_override").alias("reason"),
            F.when(~settled, as_map([(p, F.col(p)) for p in probs])).alias("probabilities"),
            F.array(*[F.lit(n) for n in self.config.features]).alias("feature_names"),
            as_map(inputs).alias("input_features"),
        )
        return out.select(*df.columns, record.alias("details"))

    def evaluate(self, df: DataFrame, label: str = "human_score") -> DataFrame:
        return evaluate(self.score(df), label, "ordinal_pred")

    def summary(self, df: DataFrame) -> DataFrame:
        """One row per boundary and feature: coefficient or importance, 4 decimals."""
        rows = []
        for boundary, model in zip(self.classes, self.binary):
            task = f"y > {boundary}"
            if isinstance(model, BoundaryModel):
                values = [*zip(self.config.features, model.coefficients.toArray()), ("intercept", model.intercept)]
            else:
                values = zip(self.config.features, model.featureImportances.toArray())
            rows += [(self.config.model_type, task, name, round(float(value), 4)) for name, value in values]
        schema = "model_type string, binary_task string, feature string, value double"
        return df.sparkSession.createDataFrame(rows, schema)


def training_table(df: DataFrame, label: str, cfg: OrdinalConfig) -> DataFrame:
    """Inputs, ``label`` and ``n`` copies of each training row.

    Rows the gate settled have no features and count as zero vectors; there is one such vector
    per label, so for the logistic models they are collapsed to a count instead of being kept
    one by one.  A forest draws rows, not weights, and keeps them.
    """
    settled = F.col("early_gate_score").isin(0, 4) if "early_gate_score" in df.columns else F.lit(False)
    settled = F.coalesce(settled, F.lit(False))
    rows = df.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("int"))
    open_rows = rows.filter(~settled).select(*_inputs(df, cfg.features), "_label", F.lit(1).cast("long").alias("n"))
    if not cfg.include_gated:
        return open_rows
    zeros = [F.lit(0.0).alias(name) for name in cfg.features]
    gated = rows.filter(settled).withColumn("n", F.lit(1).cast("long"))
    if cfg.model_type != "random_forest":
        gated = gated.groupBy("_label").agg(F.sum("n").alias("n"))
    return open_rows.unionByName(gated.select(*zeros, "_label", "n"))


def _forests(train: DataFrame, sizes: dict[int, int], cfg: OrdinalConfig) -> tuple[BinaryModel, ...]:
    """A forest per boundary; the fits are independent, and each is a chain of small jobs."""
    n = sum(sizes.values())
    assembled = VectorAssembler(inputCols=list(cfg.features), outputCol="_features").transform(train)

    def fit(boundary: int) -> BinaryModel:
        above = sum(size for c, size in sizes.items() if c > boundary)
        positive = F.col("_label") > boundary
        weight = F.when(positive, n / (2.0 * above)).otherwise(n / (2.0 * (n - above)))
        rows = assembled.select("_features", positive.cast("double").alias("_y"), (F.col("n") * weight).alias("_w"))
        forest = RandomForestClassifier(
            featuresCol="_features",
            labelCol="_y",
            weightCol="_w",
            numTrees=cfg.rf_trees,
            maxDepth=cfg.rf_max_depth,
            minInstancesPerNode=cfg.rf_min_samples_leaf,
            seed=cfg.seed,
        )
        return forest.fit(rows)

    classes = sorted(sizes)
    with ThreadPoolExecutor(len(classes) - 1) as pool:
        run = inheritable_thread_target(train.sparkSession)(fit)
        return tuple(f.result() for f in [pool.submit(run, c) for c in classes[:-1]])


def fit_ordinal(df: DataFrame, label: str = "human_score", cfg: OrdinalConfig = OrdinalConfig()) -> OrdinalModel:
    """Fit ``y > class`` for every class but the last, with balanced class weights."""
    table = training_table(df, label, cfg)
    # One row of a fixed width, whatever labels there are.
    per_grade = [F.sum(F.when(F.col("_label") == c, F.col("n"))).alias(f"n{c}") for c in RUBRIC]
    row = table.agg(*per_grade, F.count_if(~F.col("_label").isin(*RUBRIC)).alias("other")).first()
    sizes = {c: row[f"n{c}"] for c in RUBRIC if row[f"n{c}"]}
    if row["other"]:
        raise ValueError("labels must be grades 0 to 4")
    if not sizes:
        raise ValueError("no labelled rows to train on")
    classes = tuple(sorted(sizes))
    if len(classes) < 2:
        raise ValueError("training needs at least two classes")
    n = sum(sizes.values())

    # Every step of the logistic fits reads all rows; equal ones are one row with their number.  A forest draws rows.
    if cfg.model_type != "random_forest":
        table = table.groupBy(*cfg.features, "_label").agg(F.sum("n").alias("n"))
    # Read once per step, so a small table is kept in few tasks; stored, so that a lost executor costs no recomputation.
    train = materialize(table.repartition(max(1, n // ROWS_PER_TASK)), "training-rows")
    if cfg.model_type == "random_forest":
        return OrdinalModel(cfg, classes, _forests(train, sizes, cfg))
    return OrdinalModel(cfg, classes, fit_boundaries(train, cfg.features, sizes, cfg.lr_c, cfg.lr_max_iter))
