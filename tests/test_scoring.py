import math

import pytest
from pyspark.sql import functions as F

from rubrica.config import ExperimentConfig, HeuristicConfig, ThresholdSearchConfig, clean_config
from rubrica.operators import heuristic

FEATURES = "id int, early_gate_score int, nli_margin double, sbert_similarity double, lemma_recall double"


def rows(spark, *values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], FEATURES)


def test_raw_score_and_gate(spark):
    df = rows(spark, (None, 1.0, 1.0, 1.0), (None, -1.0, 0.0, 0.0), (None, None, math.nan, 1.0), (4, None, None, None), (0, 1.0, 1.0, 1.0), (None, math.inf, 0.5, 0.0))
    got = heuristic.heuristic_score(df).orderBy("id").collect()
    assert [r.heuristic_raw_score for r in got] == [1.0, 0.0, 0.15, 0.0, 1.0, 0.15]
    assert [r.heuristic_pred for r in got] == [4, 0, 0, 4, 0, 0]


def test_rubric_boundaries(spark):
    raw = spark.createDataFrame([(x,) for x in (0.1999, 0.20, 0.5, 0.60, 0.8499, 0.85)], "raw double")
    got = raw.select(heuristic.to_rubric(F.col("raw"), HeuristicConfig().thresholds).alias("g")).collect()
    assert [r.g for r in got] == [0, 1, 2, 3, 3, 4]


def test_missing_feature_columns_count_zero(spark):
    df = rows(spark, (None, 1.0, 1.0, 1.0)).drop("nli_margin", "early_gate_score")
    assert heuristic.heuristic_score(df).first().heuristic_raw_score == 0.45


def test_details(spark):
    df = rows(spark, (None, 0.5, 0.25, 1.0), (4, None, None, None))
    details = [r.details for r in heuristic.score_details(df).orderBy("id").collect()]
    assert details[0].predicted_score == 2 and details[0].raw_continuous_score == 0.5
    assert details[0].feature_contributions == {"nli_margin": 0.275, "sbert_similarity": 0.075, "lemma_recall": 0.15}
    assert details[0].reason is None and details[0].input_features["nli_margin"] == 0.5
    assert details[1].reason == "early_gate_override" and details[1].raw_continuous_score is None
    assert details[1].feature_contributions == {} and details[1].predicted_score == 4


@pytest.mark.parametrize(
    "weights", [{}, {" ": 1.0}, {"a": "1"}, {"a": -1.0}, {"a": 0.0}, {3: 1.0}, [("a", 1.0)]]
)
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        HeuristicConfig(weights)


def test_weights_are_normalised():
    assert HeuristicConfig({"a": 3, "b": 1}).normalized_weights == {"a": 0.75, "b": 0.25}


@pytest.mark.parametrize("cuts", [[0.1, 0.2, 0.3], [0.1, 0.3, 0.2, 0.4], [0.1, 0.2, 0.3, 1.1], ["a", 0.2, 0.3, 0.4]])
def test_bad_thresholds(cuts):
    with pytest.raises(ValueError):
        HeuristicConfig(thresholds=cuts)
    with pytest.raises(ValueError):
        ThresholdSearchConfig(initial=cuts)


def test_ties_pass_for_the_scorer_only():
    assert HeuristicConfig(thresholds=[0.2, 0.2, 0.3, 0.4]).thresholds == (0.2, 0.2, 0.3, 0.4)
    with pytest.raises(ValueError):
        ThresholdSearchConfig(initial=[0.2, 0.2, 0.3, 0.4])
    with pytest.raises(ValueError):
        ThresholdSearchConfig(bounds=((0.0, 0.4), (0.7, 0.2), (0.4, 0.9), (0.6, 1.0)))


def test_settings_mapping():
    cfg = ExperimentConfig.from_mapping(
        {
            "project": {"seed": 7},
            "paths": {"raw_data_dir": "in/", "processed_data_dir": "out"},
            "dataset": {"tuning_set": "t.xlsx", "allowed_score_range": [1, 3]},
            "evaluation": {"validation_size": 0.3, "stratify_validation": False},
            "features": {"use_nli": False, "nli_premise_first": "response"},
            "scoring_engine": {"heuristic_thresholds": [0.1, 0.2, 0.3, 0.4], "ml_model_type": "random_forest", "lr_C": 2},
            "thresholds": {"T1": 0.1},
            "optimization": {"maxiter": 5, "grid_search": {"bounds": {"T1_max": 0.3}}},
        }
    )
    assert cfg.heuristic.weights == {"nli_margin": 0.5, "sbert_similarity": 0.3, "lemma_recall": 0.2}
    assert cfg.heuristic.thresholds == (0.1, 0.2, 0.3, 0.4)
    assert cfg.search.initial == (0.1, 0.4, 0.6, 0.85) and cfg.search.bounds[0] == (0.0, 0.3) and cfg.search.maxiter == 5
    assert cfg.split.seed == 7 and not cfg.split.stratify and cfg.split.validation_size == 0.3
    assert cfg.features.enabled_engines == ["linguistic", "sbert"] and cfg.features.premise_first == "response"
    assert cfg.ordinal.model_type == "random_forest" and cfg.ordinal.lr_c == 2.0 and cfg.ordinal.seed == 7
    assert cfg.ingest.tuning_path == "in/t.xlsx" and cfg.ingest.allowed_score_range == (1, 3)
    assert clean_config({"noise_tags_to_remove": ["[a]"], "lowercase": False}).noise_tags == ("[a]",)
    assert clean_config({"preprocessing": {}}).gibberish_markers == ()
    with pytest.raises(ValueError):
        ExperimentConfig.from_mapping({"scoring_engine": {"rf_min_samples_split": 3}})
