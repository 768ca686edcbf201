"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import (
    CleanConfig,
    ExperimentConfig,
    FeatureConfig,
    HeuristicConfig,
    IngestConfig,
    OrdinalConfig,
    SplitConfig,
)
from rubrica.functions import lexical
from rubrica.functions.numeric import parse_label, parse_number, round4
from rubrica.functions.ordinal import class_probabilities, most_likely
from rubrica.functions.pairs import joint_similarity, nli_columns, softmax
from rubrica.functions.text import clean_text, early_gate
from rubrica.functions.vectors import cosine
from rubrica.operators import cleaning, features, heuristic, metrics, ordering, ordinal, profile, split, thresholds
from rubrica.plans import experiment, fixtures
from rubrica.session import materialize, scratch_path
from rubrica.sources import sheets, versions
from rubrica.sources.artifacts import read_table, report_table, save_table, validation_predictions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

LEXICAL_ONLY = FeatureConfig(use_sbert=False, use_nli=False)
ROW = ["sheet_name", "row_ordinal"]
# Cut points of a second, coarser rater, to compare two approaches on the same rows.
SECOND_CUTS = (0.15, 0.30, 0.50, 0.80)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.sheet_rows(spark, sf)
    return rows.filter(~sheets.is_ignored_sheet(F.col("sheet_name")))


def _tuning(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.load_pairs(_rows(spark, sf), "tuning")


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Every sheet row, cleaned and gated, blank answers included."""
    rows = _rows(spark, sf)
    named = rows.withColumn("stimulus", sheets.strip_item_suffix(F.col("stimulus")))
    return cleaning.preprocess_pairs(cleaning.with_labels(named))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    rated = fixtures.rated(spark, sf)
    return thresholds.apply_thresholds(rated, "raw", HeuristicConfig().thresholds)


# --- ingest -------------------------------------------------------------------------------


@query
def sheet_names(spark, sf):
    names = fixtures.sheet_rows(spark, sf).select("sheet_name").distinct()
    name = F.col("sheet_name")
    return names.select(
        name,
        sheets.is_ignored_sheet(name).alias("ignored"),
        sheets.participant_id(name).alias("participant_id"),
    )


@query
def load_standardize(spark, sf):
    return sheets.standardize(_rows(spark, sf), "tuning").drop("sheet_ordinal")


@query
def load_dedup_first(spark, sf):
    """Every row twice, the later copy with another score: the first must win."""
    rows = _rows(spark, sf)
    later = rows.withColumns(
        {"row_ordinal": F.col("row_ordinal") + 1_000_000, "human_score": F.lit("2")}
    )
    return sheets.load_pairs(rows.unionByName(later), "tuning").drop("sheet_ordinal")


def _as_files(rows: DataFrame, folder: str, part: int, headers: tuple[str, str, str]) -> None:
    """The sheets of one part in three as a table with headers of its own."""
    own = F.pmod(F.regexp_extract("sheet_name", r"(\d+)", 1).cast("bigint"), F.lit(3)) == part
    columns = [F.col(c).alias(h) for c, h in zip(("stimulus", "transcription", "human_score"), headers)]
    rows.filter(own).select("sheet_name", "row_ordinal", *columns).write.mode("overwrite").parquet(f"{folder}/{part}")


HEADERS = (
    ("Target", "Response", "Score"),
    ("Source Sentence", "Student Transcription", "Grade"),
    ("Prompt text", "My response", "Rubric"),
)


@query
def sheets_of_several_headers(spark, sf):
    """Every sheet through files of three sets of headers."""
    folder = scratch_path(spark, "sheets")
    rows = fixtures.sheet_rows(spark, sf)
    for part, headers in enumerate(HEADERS):
        _as_files(rows, folder, part, headers)
    return sheets.standardize(sheets.read_sheets(spark, f"{folder}/*"), "tuning").drop("sheet_ordinal")


@query
def sheet_cache_refresh(spark, sf):
    """A cached load after a third of the sheets got other scores and a third was deleted."""
    folder = scratch_path(spark, "sheets")
    cfg = IngestConfig(cache_dir=scratch_path(spark, "cache"))
    rows = fixtures.sheet_rows(spark, sf)  # a part only takes the documents of its sheets
    for part, headers in enumerate(HEADERS):
        _as_files(rows, folder, part, headers)
    sheets.load_role(spark, f"{folder}/*", "tuning", cfg)
    _as_files(rows.withColumn("human_score", F.lit("2")), folder, 1, HEADERS[1])
    versions.remove(spark, f"{folder}/2")
    return sheets.load_role(spark, f"{folder}/*", "tuning", cfg).drop("sheet_ordinal")


@query
def load_reports_of_run(spark, sf):
    """The report that comes with a load of two catalog tables named in the settings."""
    named = fixtures.sheet_rows(spark, sf).withColumnsRenamed(dict(zip(("stimulus", "transcription", "human_score"), HEADERS[0])))
    materialize(named, "sheet-table").createOrReplaceTempView("sheet_table")
    cfg = IngestConfig(tuning_table="sheet_table", holdout_table="sheet_table")
    return sheets.load_data_with_reports(spark, cfg)[2]


@query
def saved_table_by_sheet(spark, sf):
    """Validated pairs saved twice, read back from the newer version, counted by its partitions."""
    folder = scratch_path(spark, "tables")
    pairs = sheets.standardize(_rows(spark, sf), "tuning")
    by_sheet = pairs.withColumn("part", F.pmod(F.length("sheet_name"), F.lit(7)))
    save_table(by_sheet.withColumn("human_score", F.lit(0.0)), folder, "pairs", partition_by=["part"])
    save_table(by_sheet, folder, "pairs", partition_by=["part"])
    return read_table(spark, folder, "pairs").groupBy("part").agg(
        F.count("*").alias("n"), F.count("human_score").alias("scored"), F.countDistinct("sheet_name").alias("sheets")
    )


@query
def load_holdout(spark, sf):
    rows = _rows(spark, sf).withColumn("human_score", F.lit(None).cast("string"))
    return sheets.load_pairs(rows, "holdout").drop("sheet_ordinal")


@query
def load_report(spark, sf):
    return sheets.load_report(_rows(spark, sf), "tuning")


@query
def load_summary(spark, sf):
    rows = fixtures.sheet_rows(spark, sf)
    return sheets.load_summary(load_report(spark, sf), rows.select("sheet_name").distinct())


@query
def label_parse(spark, sf):
    score = F.col("human_score")
    parsed = _rows(spark, sf).select(parse_number(score).alias("number"), parse_label(score).alias("label"))
    return parsed.groupBy("number", "label").agg(
        F.count("*").alias("n"), F.bool_and(F.col("number") % 1 == 0).alias("integral")
    )


@query
def row_numbering(spark, sf):
    pairs = _tuning(spark, sf)
    return ordering.with_row_index(pairs, experiment.ORDER).select("row_index", *ROW)


@query
def sample_head(spark, sf):
    return ordering.first_rows(_tuning(spark, sf), experiment.ORDER, 10).drop("sheet_ordinal")


# --- text and gate ------------------------------------------------------------------------


@query
def clean_documents(spark, sf):
    docs = fixtures.spread_table(spark, sf, "documents", "doc_id", ["doc_id", "text"])
    clean = docs.select("doc_id", clean_text(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("n_clean"))


@query
def clean_pages(spark, sf):
    pages = fixtures.spread_table(spark, sf, "pages", "page_id", ["page_id", "html"])
    clean = pages.select("page_id", clean_text(F.col("html")).alias("clean"))
    return clean.select("page_id", F.md5("clean").alias("digest"), F.length("clean").alias("n_clean"))


@query
def clean_keep_accents(spark, sf):
    """Accents and case kept, punctuation removed."""
    cfg = CleanConfig(lowercase=False, normalize_accents=False)
    docs = fixtures.spread_table(spark, sf, "documents", "doc_id", ["doc_id", "text"])
    clean = docs.select("doc_id", clean_text(F.col("text"), cfg).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("n_clean"))


@query
def clean_noisy_pairs(spark, sf):
    return _cleaned(spark, sf).select(*ROW, "clean_stimulus", "clean_response")


@query
def early_gate_rows(spark, sf):
    """The gate on texts that were not cleaned: it folds white space itself."""
    gate = early_gate(F.col("stimulus"), F.col("transcription"))
    raw = _rows(spark, sf).withColumn("stimulus", sheets.strip_item_suffix(F.col("stimulus")))
    return raw.select(*ROW, gate.alias("gate"))


@query
def gate_summary(spark, sf):
    return cleaning.gate_summary(_cleaned(spark, sf))


@query
def eda_exact_match(spark, sf):
    return profile.exact_match_profile(_rows(spark, sf))


@query
def label_distribution(spark, sf):
    return profile.label_distribution(fixtures.rated(spark, sf), "y")


@query
def quality_distribution(spark, sf):
    return profile.label_distribution(fixtures.table(spark, sf, "labels"), "quality")


# --- features -----------------------------------------------------------------------------


def _overlap(df: DataFrame, key: list[str], words: DataFrame | None = None) -> DataFrame:
    return features.lexical_features(df, key, words).select(*key, *lexical.LEXICAL_FEATURES)


@query
def lemma_overlap(spark, sf):
    cleaned = materialize(_cleaned(spark, sf).select(*ROW, *features.PAIR), "cleaned")
    return _overlap(cleaned, ROW, materialize(fixtures.lexicon(cleaned), "lexicon"))


@query
def word_overlap(spark, sf):
    return _overlap(_cleaned(spark, sf), ROW)


@query
def conv_overlap(spark, sf):
    return _overlap(fixtures.conversation_pairs(spark, sf), ["conv_id", "turn"])


@query
def vector_cosine(spark, sf):
    pairs = fixtures.vector_pairs(spark, sf)
    return pairs.select("vec_id", cosine(F.col("a"), F.col("b"), unit=False).alias("sbert_similarity"))


@query
def hash_embed_cosine(spark, sf):
    cleaned = materialize(_cleaned(spark, sf), "cleaned")
    pairs = cleaned.filter(F.col("early_gate_score").isNull()).select(*features.PAIR).distinct()
    return features.vector_similarity(materialize(pairs, "pairs"), features.hashed_embedder())


@query
def pair_margin(spark, sf):
    outputs = fixtures.model_outputs(spark, sf).withColumn("p", softmax(F.col("logits")))
    positions = {"entailment": 0, "neutral": 1, "contradiction": 2}
    return outputs.select("vec_id", *nli_columns(F.col("p"), positions))


@query
def shared_word_margin(spark, sf):
    """The pair-model slot on distinct open pairs, with the stand-in that counts shared words."""
    cleaned = materialize(_cleaned(spark, sf), "cleaned")
    pairs = cleaned.filter(F.col("early_gate_score").isNull() & (F.col("clean_stimulus") != ""))
    return features.nli_features(pairs.select(*features.PAIR).distinct(), features.overlap_pair_model())


@query
def joint_pair_similarity(spark, sf):
    outputs = fixtures.model_outputs(spark, sf)
    return outputs.select("vec_id", joint_similarity(F.col("score")).alias("cross_encoder_similarity"))


@query
def gated_features(spark, sf):
    cleaned = _cleaned(spark, sf)
    routed = features.gated_features(cleaned, ROW, cfg=LEXICAL_ONLY)
    return routed.select(*ROW, "human_score", "early_gate_score", *lexical.LEXICAL_FEATURES)


@query
def model_features(spark, sf):
    """All engines, with the built-in stand-in models, on the rows the gate leaves open."""
    stand_ins = features.Models(stand_ins=True)
    routed = features.gated_features(materialize(_cleaned(spark, sf), "cleaned"), ROW, stand_ins)
    return routed.select(*ROW, "early_gate_score", *features.feature_names(FeatureConfig()))


# --- heuristic scorer ---------------------------------------------------------------------


@query
def contributions(spark, sf):
    pairs = fixtures.feature_pairs(spark, sf)
    parts = heuristic.contributions(pairs)
    return pairs.select("id", *[value.alias(f"part_{name}") for name, value in parts.items()])


@query
def raw_score(spark, sf):
    pairs = fixtures.feature_pairs(spark, sf)
    return pairs.select("id", heuristic.raw_score(pairs).alias("heuristic_raw_score"))


@query
def rubric(spark, sf):
    scored = heuristic.heuristic_score(fixtures.feature_pairs(spark, sf))
    return scored.select("id", "heuristic_raw_score", "heuristic_pred")


@query
def score_details(spark, sf):
    details = heuristic.score_details(fixtures.feature_pairs(spark, sf)).select("id", "details.*")
    parts, weights = F.col("feature_contributions"), F.col("applied_weights")
    return details.select(
        "id",
        "predicted_score",
        "raw_continuous_score",
        "reason",
        F.try_element_at(parts, F.lit("nli_margin")).alias("part_nli_margin"),
        F.size(parts).alias("n_parts"),
        weights["lemma_recall"].alias("weight_lemma_recall"),
    )


# --- agreement ----------------------------------------------------------------------------


@query
def confusion(spark, sf):
    return metrics.confusion_matrix(_predicted(spark, sf), "y", "pred")


@query
def agreement(spark, sf):
    return metrics.evaluate(_predicted(spark, sf), "y", "pred")


@query
def agreement_by_group(spark, sf):
    return metrics.evaluate(_predicted(spark, sf), "y", "pred", by=["status"])


@query
def qwk_absent_label(spark, sf):
    """Class 2 neither given nor predicted: classes 1 and 3 become neighbours."""
    kept = _predicted(spark, sf).filter((F.col("y") != 2) & (F.col("pred") != 2))
    return metrics.evaluate(kept, "y", "pred")


@query
def class_report(spark, sf):
    return metrics.classification_report(_predicted(spark, sf), "y", "pred")


@query
def off_by_k(spark, sf):
    return metrics.error_profile(_predicted(spark, sf), "y", "pred")


# --- split and thresholds -----------------------------------------------------------------


@query
def stratified_split(spark, sf):
    return split.split_labeled(fixtures.rated(spark, sf), "id", "y").select("id", "y", "split")


@query
def plain_split(spark, sf):
    cfg = SplitConfig(stratify=False)
    return split.split_labeled(fixtures.rated(spark, sf), "id", "y", cfg).select("id", "y", "split")


@query
def threshold_histogram(spark, sf):
    return thresholds.score_histogram(fixtures.rated(spark, sf), "raw", "y")


@query
def threshold_predict(spark, sf):
    rated = fixtures.rated(spark, sf)
    return thresholds.apply_thresholds(rated, "raw", SECOND_CUTS).select("id", "raw", "pred")


@query
def threshold_evaluate(spark, sf):
    return thresholds.evaluate_thresholds(fixtures.rated(spark, sf), "raw", "y", SECOND_CUTS)


@query
def threshold_grid_best(spark, sf):
    cfg = ExperimentConfig().search
    histogram = thresholds.score_histogram(fixtures.rated(spark, sf), "raw", "y")
    running = materialize(thresholds.running_counts(histogram), "running-counts")
    best = thresholds.best_candidate(thresholds.score_candidates(running, cfg))
    return best.select(*thresholds.CUTS, round4(F.col("qwk")).alias("qwk"))


@query
def threshold_refined(spark, sf):
    cuts, qwk = thresholds.fit_thresholds(fixtures.rated(spark, sf), "raw", "y")
    schema = "t1 double, t2 double, t3 double, t4 double, qwk double"
    return spark.createDataFrame([(*cuts, round(qwk, 4))], schema)


@query
def threshold_compare(spark, sf):
    rated = fixtures.rated(spark, sf)
    cuts, _ = thresholds.fit_thresholds(rated, "raw", "y")
    return thresholds.compare_thresholds(rated, "raw", "y", cuts)


# --- ordinal model ------------------------------------------------------------------------


@query
def ordinal_proba_recover(spark, sf):
    greater = [F.col(f"g{i}") for i in range(4)]
    recovered = fixtures.model_outputs(spark, sf).withColumn("p", class_probabilities(greater))
    p = F.col("p")
    return recovered.select(
        "vec_id",
        *[round4(p[i]).alias(f"prob_{i}") for i in range(5)],
        most_likely(p, range(5)).alias("ordinal_pred"),
    )


def _split_features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sides = split.split_labeled(fixtures.feature_pairs(spark, sf), "id")
    return (sides.filter(F.col("split") == side).drop("split") for side in ("train", "validation"))


@query
def ordinal_logistic(spark, sf):
    train, validation = _split_features(spark, sf)
    model = ordinal.fit_ordinal(train)
    scored = model.predict_proba(model.score(validation))
    return scored.select("id", "ordinal_pred", *[f"prob_{c}" for c in range(5)])


@query
def ordinal_forest(spark, sf):
    train, validation = _split_features(spark, sf)
    model = ordinal.fit_ordinal(train, cfg=OrdinalConfig(model_type="random_forest"))
    return model.evaluate(validation)


@query
def ordinal_summary(spark, sf):
    pairs = fixtures.feature_pairs(spark, sf)
    return ordinal.fit_ordinal(pairs).summary(pairs)


# --- experiment ---------------------------------------------------------------------------


def _two_raters(spark: SparkSession, sf: str) -> DataFrame:
    scored = heuristic.heuristic_score(fixtures.feature_pairs(spark, sf))
    second = heuristic.to_rubric(F.col("heuristic_raw_score"), SECOND_CUTS)
    return scored.withColumn("ordinal_pred", F.coalesce(F.col("early_gate_score"), second))


@query
def ab_summary(spark, sf):
    return experiment.ab_summary(_two_raters(spark, sf))


@query
def ab_winner(spark, sf):
    return experiment.winner(experiment.ab_summary(_two_raters(spark, sf)))


@query
def validation_table(spark, sf):
    return validation_predictions(_two_raters(spark, sf).withColumnRenamed("id", "row_index"))


@query
def holdout_score(spark, sf):
    """Both fitted scorers on unlabelled rows."""
    pairs = fixtures.feature_pairs(spark, sf)
    fitted, _, _ = experiment.fit_scorers(pairs)
    scored = fitted.score(pairs.drop("human_score"))
    return scored.select("id", "early_gate_score", "heuristic_raw_score", "heuristic_pred", "ordinal_pred")


@query
def tuning_audit(spark, sf):
    """Numbered records with labels, cleaned texts, gate and word overlap."""
    return experiment.process_dataset(_tuning(spark, sf), ExperimentConfig(features=LEXICAL_ONLY))


@query
def sanity_check(spark, sf):
    """The first three pairs through the same steps."""
    return experiment.sanity_check(_tuning(spark, sf), ExperimentConfig(features=LEXICAL_ONLY))


@query
def report_export(spark, sf):
    pairs = cleaning.preprocess_pairs(cleaning.with_labels(_tuning(spark, sf)))
    routed = features.gated_features(pairs, ROW, cfg=LEXICAL_ONLY)
    return report_table(heuristic.heuristic_score(routed, HeuristicConfig({"lemma_recall": 1.0})))


@query
def experiment_summary(spark, sf):
    stand_ins = features.Models(stand_ins=True)
    return experiment.run_experiment(_tuning(spark, sf), models=stand_ins)["experiment_summary"]


@query
def overlap_agreement(spark, sf):
    """From sheet rows to agreement: clean, gate, word overlap, rubric, metrics."""
    routed = features.gated_features(_cleaned(spark, sf), ROW, cfg=LEXICAL_ONLY)
    scored = heuristic.heuristic_score(routed, HeuristicConfig({"lemma_recall": 1.0}))
    return metrics.evaluate(scored, "human_score", "heuristic_pred")
