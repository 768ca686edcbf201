"""Cleaned texts and the early gate over a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.config import CleanConfig
from rubrica.functions.numeric import parse_label
from rubrica.functions.text import clean_text, early_gate_score
from rubrica.sources.headers import detect_score_column


def preprocess_pairs(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Add ``clean_stimulus``, ``clean_response`` and the nullable ``early_gate_score``."""
    cleaned = df.withColumns(
        {
            "clean_stimulus": clean_text(F.col("stimulus"), cfg),
            "clean_response": clean_text(F.col("transcription"), cfg),
        }
    )
    gate = early_gate_score(F.col("clean_stimulus"), F.col("clean_response"), normalized=True)
    return cleaned.withColumn("early_gate_score", gate)


def with_labels(df: DataFrame, score_column: str | None = None) -> DataFrame:
    """Integer ``human_score`` from the detected score column; null where there is none."""
    column = score_column or detect_score_column(df.columns)
    label = parse_label(F.col(f"`{column}`")) if column else F.lit(None).cast("int")
    return df.withColumn("human_score", label)


def gate_summary(df: DataFrame) -> DataFrame:
    """One row: how many rows the gate settles, how many need features, how many are labelled."""
    gate = F.col("early_gate_score")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("human_score").isNotNull()).alias("labelled"),
        F.count_if(gate == 0).alias("score_0"),
        F.count_if(gate == 4).alias("score_4"),
        F.count_if(gate.isNull()).alias("needs_features"),
    )
