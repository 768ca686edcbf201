import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rubrica.config import ExperimentConfig, FeatureConfig, HeuristicConfig, IngestConfig, OrdinalConfig
from rubrica.operators.features import Models
from rubrica.operators.ordering import first_rows, with_row_index
from rubrica.plans import catalog, experiment
from rubrica.session import materialize, scratch_dir
from rubrica.sources import artifacts, sheets
from rubrica.streaming.scoring import score_stream, write_scores

from conftest import SMALL

WORDS = ExperimentConfig(
    features=FeatureConfig(use_sbert=False, use_nli=False),
    heuristic=HeuristicConfig({"lemma_recall": 1.0}),
    ordinal=OrdinalConfig(features=("lemma_recall",)),
)
STAND_INS = Models(stand_ins=True)


@pytest.fixture(scope="module")
def tuning(spark):
    return materialize(catalog._tuning(spark, SMALL), "tuning")


@pytest.fixture(scope="module")
def result(spark, tuning, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    holdout = tuning.withColumn("human_score", F.lit(None).cast("double"))
    cfg = ExperimentConfig(output_dir=out)
    return out, experiment.run_experiment(tuning, holdout, cfg, STAND_INS)


def test_row_index(spark, tuning):
    rows = with_row_index(tuning, experiment.ORDER).collect()
    ordered = sorted(rows, key=lambda r: (r.sheet_ordinal, r.sheet_name, r.row_ordinal))
    assert [r.row_index for r in ordered] == list(range(len(rows)))


def test_audit_has_every_row(result, tuning):
    audit = result[1]["tuning_audit"]
    assert audit.count() == tuning.count() and audit.select("row_index").distinct().count() == tuning.count()
    assert audit.columns[:9] == list(artifacts.AUDIT_COLUMNS) and len(audit.columns) == 22
    settled = audit.filter(F.col("early_gate_score").isNotNull())
    assert settled.filter(F.col("nli_margin").isNotNull() | F.col("lemma_recall").isNotNull()).isEmpty()
    assert audit.filter(F.col("early_gate_score").isNull() & F.col("nli_margin").isNull()).isEmpty()


def test_validation_predictions(result):
    audit, predictions = result[1]["tuning_audit"], result[1]["validation_predictions"]
    assert predictions.columns == [
        "original_row_index", "human_score", "early_gate_score", "heuristic_pred", "ordinal_pred", "heuristic_raw_score",
    ]
    labelled = audit.filter(F.col("human_score").isNotNull()).count()
    assert predictions.count() == -(-labelled // 5)
    settled = predictions.filter(F.col("early_gate_score").isNotNull())
    wrong = (F.col("heuristic_pred") != F.col("early_gate_score")) | (F.col("ordinal_pred") != F.col("early_gate_score")) | (F.col("heuristic_raw_score") != 0)
    assert settled.count() > 0 and settled.filter(wrong).isEmpty()


def test_summary_winner_and_report(result):
    tables = result[1]
    summary = {r.approach: r for r in tables["experiment_summary"].collect()}
    assert set(summary) == {"heuristic", "ordinal_ml"}
    best = tables["winner"].first()
    assert best.qwk == max(r.qwk for r in summary.values()) == summary[best.winner].qwk
    compared = {r.stage: r.qwk for r in tables["threshold_comparison"].collect()}
    assert compared["optimized"] >= compared["initial"]
    assert tables["report"].columns == list(artifacts.REPORT_COLUMNS.values())
    assert tables["report"].count() == tables["holdout_predictions"].count() == tables["tuning_audit"].count()


def test_artifacts_can_be_read_back(spark, result):
    out, tables = result
    stored = artifacts.read_table(spark, out, "holdout_predictions")
    assert stored.count() == tables["holdout_predictions"].count()
    assert artifacts.report_table(stored).count() == stored.count()
    assert artifacts.read_table(spark, out, "final_report", "csv").count() == stored.count()
    with pytest.raises(Exception):
        artifacts.read_table(spark, out, "nothing")


def test_saved_tables_have_versions(spark, tmp_path, plan_of):
    out = str(tmp_path)
    frame = lambda x: spark.createDataFrame([(x, "a"), (x, "b")], "x int, sheet string")
    for x in (1, 2, 3):
        saved = artifacts.save_table(frame(x), out, "t", partition_by=["sheet"])
        assert [r.x for r in saved.collect()] == [x, x]
    assert sorted(p.name for p in (tmp_path / "t").glob("version=*")) == ["version=2", "version=3"]
    one = artifacts.read_table(spark, out, "t").filter("sheet = 'a'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(sheet" in plan_of(one)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    out = str(tmp_path)
    artifacts.save_table(spark.range(5), out, "t")
    broken = spark.range(5).withColumn("id", F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("boom")).cast("long")))
    with pytest.raises(Exception, match="boom"):
        artifacts.save_table(broken, out, "t")
    assert artifacts.read_table(spark, out, "t").count() == 5
    (tmp_path / "t" / "version=77").mkdir()  # a writer that never finished
    assert artifacts.read_table(spark, out, "t").count() == 5
    assert artifacts.save_table(spark.range(3), out, "t").count() == 3
    assert artifacts.read_table(spark, out, "t").count() == 3


def test_report_needs_every_column(spark):
    with pytest.raises(ValueError, match="heuristic_pred"):
        artifacts.report_table(spark.createDataFrame([("P1",)], "participant_id string"))


def test_heuristic_wins_a_tie(spark):
    schema = "evaluation_split string, approach string, qwk double, accuracy double, macro_f1 double"

    def best(h, o):
        rows = [("v", "heuristic", h, 0.0, 0.0), ("v", "ordinal_ml", o, 0.0, 0.0)]
        return experiment.winner(spark.createDataFrame(rows, schema)).first()

    assert tuple(best(0.8, 0.8)) == ("heuristic", 0.8, "expert")
    assert best(0.7, 0.75).winner == "ordinal_ml" and best(0.7, 0.75).agreement == "below_expert"
    assert best(None, 0.1).winner == "ordinal_ml"


def test_empty_tuning_stops(spark, tuning):
    with pytest.raises(ValueError):
        experiment.run_experiment(tuning.limit(0), models=STAND_INS)


def test_empty_holdout_is_skipped(spark, tuning):
    tables = experiment.run_experiment(tuning, tuning.limit(0), WORDS)
    assert "holdout_predictions" not in tables and "report" not in tables


def test_experiment_from_files(spark, tmp_path):
    def sheet(start):
        words = ["la casa es roja", "el perro come pan", "uno dos gato", "hay luz hoy"]
        items = [(f"{words[i % 4]} {chr(97 + start)}{i} (7)", i) for i in range(24)]
        answers = [(s, s[:-4] if i % 3 == 0 else "[pause] xx" if i % 3 == 1 else s.split()[0] + " algo", [4, 0, 1 + i % 3][i % 3]) for s, i in items]
        return {"Target": [a[0] for a in answers], "Response": [a[1] for a in answers], "Score": [a[2] for a in answers]}

    for name, scored in (("tuning", True), ("holdout", False)):
        book = {f"Participant {k}": sheet(k) for k in range(3)} | {"Info": {"Target": ["x"], "Response": ["x"]}}
        if not scored:
            for part in book.values():
                part.pop("Score", None)
        (tmp_path / f"{name}.json").write_text(json.dumps(book))

    def codec(path, content):
        return {k: pd.DataFrame(v) for k, v in json.loads(content).items()}

    cfg = ExperimentConfig(ingest=IngestConfig(tuning_path=str(tmp_path / "tuning.json"), holdout_path=str(tmp_path / "holdout.json")))
    tables = experiment.run_from_files(spark, cfg, STAND_INS, codec)
    assert tables["tuning_audit"].count() == 72 and tables["holdout_predictions"].count() == 72
    assert tables["holdout_predictions"].filter("human_score is not null").isEmpty()


def test_sanity_check(spark, tuning):
    rows = experiment.sanity_check(tuning, models=STAND_INS).collect()
    first = first_rows(tuning, experiment.ORDER, 3).collect()
    assert sorted(r.stimulus for r in rows) == sorted(r.stimulus for r in first) and len(rows) == 3


def test_streaming_equals_batch(spark, tuning, tmp_path):
    fitted, _, _ = experiment.fit_scorers(materialize(experiment.process_dataset(tuning, WORDS), "train"), WORDS)
    source = str(tmp_path / "in")
    tuning.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(sheets.PAIR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = write_scores(score_stream(stream, fitted), str(tmp_path / "out"), str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    columns = ["sheet_name", "row_ordinal", "heuristic_raw_score", "heuristic_pred", "ordinal_pred"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    batch = score_stream(tuning, fitted).select(*columns).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch)) and len(batch) > 0


def test_stream_without_weighted_features_is_rejected(spark, tuning):
    fitted, _, _ = experiment.fit_scorers(materialize(experiment.process_dataset(tuning, WORDS), "train"), WORDS)
    other = experiment.Fitted(HeuristicConfig(), fitted.ordinal)
    with pytest.raises(ValueError, match="nli_margin"):
        score_stream(tuning, other)


def test_missing_models_are_an_error(spark, tuning):
    with pytest.raises(ValueError, match="no model"):
        experiment.process_dataset(tuning)


def test_scratch_folder_comes_from_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark) == shared
    stored = materialize(spark.range(5), "five")
    assert stored.count() == 5 and shared in stored.inputFiles()[0]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session)
