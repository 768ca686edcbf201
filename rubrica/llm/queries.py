"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import (
    alignment,
    attribution,
    chat,
    decontaminate,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    quality,
    suffix_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(_table(spark, sf_dir, "documents")))


def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(_table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with id -1 whose texts hold control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return chat.report(chat.read_back(chat.build(turns.unionByName(extra))))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.count_tokens(_table(spark, sf_dir, "documents"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.report(docs, line_dedup.decide(docs))


def quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.report(quality.score(docs, model))


def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(_table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_sentence_rules": license_sentence_rules,
    "op2_suffix_repeats": suffix_repeats,
    "op3_best_fit_packing": best_fit_packing,
    "op4_ngram_jaccard_join": ngram_jaccard_join,
    "op5_chat_prefix_tree": chat_prefix_tree,
    "op6_embedding_near_dedup": embedding_near_dedup,
    "op7_token_attribution": token_attribution,
    "op8_benchmark_decontamination": benchmark_decontamination,
    "op9_fuzzy_line_dedup": fuzzy_line_dedup,
    "op10_quality_attention": quality_attention,
    "op11_cross_tokenizer_alignment": cross_tokenizer_alignment,
    "op12_hard_negative_mining": hard_negative_mining,
    "op13_extendible_hash_dedup": extendible_hash_dedup,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_sentence_rules": licenses.oracle_sql(),
    "op4_ngram_jaccard_join": ngram_join.oracle_sql(),
    "op5_chat_prefix_tree": chat.oracle_sql(),
    "op6_embedding_near_dedup": embedding_dedup.oracle_sql(),
    "op8_benchmark_decontamination": decontaminate.oracle_sql(),
    "op12_hard_negative_mining": hard_negatives.oracle_sql(),
    "op13_extendible_hash_dedup": exact_dedup.oracle_sql(),
}
