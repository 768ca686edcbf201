"""The whole experiment: fit both approaches, validate, compare, score the holdout."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import ExperimentConfig, HeuristicConfig
from rubrica.operators.cleaning import gate_summary, preprocess_pairs, with_labels
from rubrica.operators.features import Models, feature_names, gated_features
from rubrica.operators.heuristic import heuristic_score, raw_score
from rubrica.operators.metrics import agreement_level, evaluate
from rubrica.operators.ordering import first_rows, with_row_index
from rubrica.operators.ordinal import OrdinalModel, fit_ordinal
from rubrica.operators.split import split_labeled
from rubrica.operators.thresholds import compare_thresholds, fit_thresholds
from rubrica.session import materialize
from rubrica.sources.artifacts import audit_table, report_table, save_table, validation_predictions
from rubrica.sources.sheets import Codec, load_data_with_reports

ORDER = ["sheet_ordinal", "sheet_name", "row_ordinal"]
SPLIT_NAME = "validation_from_tuning"


@dataclass(frozen=True)
class Fitted:
    """Everything needed to score new rows."""

    heuristic: HeuristicConfig
    ordinal: OrdinalModel

    def score(self, df: DataFrame) -> DataFrame:
        """Both predictions: a projection, so it serves batch and streaming tables alike."""
        return self.ordinal.score(heuristic_score(df, self.heuristic))


def process_dataset(
    pairs: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), models: Models = Models()
) -> DataFrame:
    """Labels, cleaned texts, gate and features of every pair, numbered in sheet order."""

    def clean(rows: DataFrame) -> DataFrame:
        return preprocess_pairs(with_labels(rows), cfg.clean)

    # The numbering writes the cleaned table, which the feature engines then read.
    indexed = with_row_index(pairs, [c for c in ORDER if c in pairs.columns], then=clean)
    features = gated_features(indexed, ["row_index"], models, cfg.features)
    return audit_table(features, feature_names(cfg.features))


def fit_scorers(
    train: DataFrame, cfg: ExperimentConfig = ExperimentConfig()
) -> tuple[Fitted, list[float], float | None]:
    """Approach A tunes its cut points on rows the gate left open, B trains on all rows.

    Without open rows the cut points stay as they are.
    """
    open_rows = train.filter(F.col("early_gate_score").isNull())
    cuts, qwk = list(cfg.heuristic.thresholds), None
    if not open_rows.isEmpty():
        scored = open_rows.select("human_score", raw_score(open_rows, cfg.heuristic).alias("raw"))
        cuts, qwk = fit_thresholds(scored, "raw", "human_score", cfg.search)
    heuristic = replace(cfg.heuristic, thresholds=tuple(cuts))
    return Fitted(heuristic, fit_ordinal(train, "human_score", cfg.ordinal)), cuts, qwk


def ab_summary(scored: DataFrame, label: str = "human_score") -> DataFrame:
    """One row per approach with its metrics."""
    long = scored.select(
        label,
        F.inline(
            F.array(
                F.struct(F.lit("heuristic").alias("approach"), F.col("heuristic_pred").alias("pred")),
                F.struct(F.lit("ordinal_ml").alias("approach"), F.col("ordinal_pred").alias("pred")),
            )
        ),
    )
    metrics = evaluate(long, label, "pred", by=["approach"])
    return metrics.select(
        F.lit(SPLIT_NAME).alias("evaluation_split"), "approach", "qwk", "accuracy", "macro_f1"
    )


def winner(summary: DataFrame) -> DataFrame:
    """The approach with the higher QWK, the heuristic on a tie, and its level of agreement."""
    # A missing QWK loses every comparison, as NaN does.
    qwk = {
        a: F.max(F.when(F.col("approach") == a, F.col("qwk"))) for a in ("heuristic", "ordinal_ml")
    }
    best = summary.agg(*[v.alias(a) for a, v in qwk.items()])
    heuristic_wins = F.coalesce(F.col("heuristic") >= F.col("ordinal_ml"), F.lit(False))
    won = F.when(heuristic_wins, F.col("heuristic")).otherwise(F.col("ordinal_ml"))
    return best.select(
        F.when(heuristic_wins, "heuristic").otherwise("ordinal_ml").alias("winner"),
        won.alias("qwk"),
        agreement_level(won).alias("agreement"),
    )


def sanity_check(
    pairs: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), models: Models = Models(), n: int = 3
) -> DataFrame:
    """The first rows through cleaning, gate and features, to look at."""
    return process_dataset(first_rows(pairs, [c for c in ORDER if c in pairs.columns], n), cfg, models)


def run_experiment(
    tuning: DataFrame,
    holdout: DataFrame | None = None,
    cfg: ExperimentConfig = ExperimentConfig(),
    models: Models = Models(),
) -> dict[str, DataFrame]:
    """Fit on tuning pairs, validate, score the holdout; the result tables by name.

    With ``cfg.output_dir`` set the tables are written there and returned as read back.
    """
    def keep(df: DataFrame, name: str) -> DataFrame:
        return save_table(df, cfg.output_dir, name) if cfg.output_dir else materialize(df, name)

    # Tested once the numbered rows are stored; before, the test would run the whole ingest.
    processed = process_dataset(tuning, cfg, models)
    if processed.isEmpty():
        raise ValueError("the tuning data set is empty")
    # Read by the split, both fits and the scoring below, so it is written first.
    audit = keep(processed, "tuning_audit")
    # The fits need no texts.
    numbers = audit.select("row_index", "human_score", "early_gate_score", *feature_names(cfg.features))
    sides = materialize(split_labeled(numbers, "row_index", "human_score", cfg.split), "split")
    train = sides.filter(F.col("split") == "train").drop("split")
    validation = sides.filter(F.col("split") == "validation").drop("split")

    fitted, cuts, fit_qwk = fit_scorers(train, cfg)
    scored = materialize(fitted.score(validation), "scored")
    summary = keep(ab_summary(scored), "experiment_summary")

    open_train = train.filter(F.col("early_gate_score").isNull())
    raw = open_train.select("human_score", raw_score(open_train, cfg.heuristic).alias("raw"))
    tables = {
        "tuning_audit": audit,
        "gate_summary": gate_summary(audit),
        "validation_predictions": keep(validation_predictions(scored), "validation_predictions"),
        "experiment_summary": summary,
        "winner": winner(summary),
        "train_metrics": evaluate(heuristic_score(train, fitted.heuristic), "human_score", "heuristic_pred"),
        "threshold_comparison": compare_thresholds(raw, "raw", "human_score", cuts, cfg.search),
        "fitted_thresholds": audit.sparkSession.createDataFrame(
            [(*cuts, fit_qwk)], "t1 double, t2 double, t3 double, t4 double, qwk double"
        ),
        "ordinal_model": fitted.ordinal.summary(audit),
    }
    if holdout is None:
        return tables
    processed = process_dataset(holdout, cfg, models)
    if not processed.isEmpty():
        predictions = keep(fitted.score(processed), "holdout_predictions")
        tables["holdout_predictions"] = predictions
        report = report_table(predictions)
        tables["report"] = save_table(report, cfg.output_dir, "final_report", "csv") if cfg.output_dir else report
    return tables


def run_from_files(
    spark: SparkSession,
    cfg: ExperimentConfig,
    models: Models = Models(),
    codec: Codec | None = None,
) -> dict[str, DataFrame]:
    """Load both data sets named in the settings (files or tables) and run the experiment on them.

    ``load_report`` says per role and sheet what was dropped and why; it is a by-product of the load.
    """
    tuning, holdout, reports = load_data_with_reports(spark, cfg.ingest, codec)
    reports = save_table(reports, cfg.output_dir, "load_report") if cfg.output_dir else reports
    return run_experiment(tuning, holdout, cfg, models) | {"load_report": reports}
