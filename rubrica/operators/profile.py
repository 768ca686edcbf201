"""Profiles of a labelled table: label distribution and exact-match rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.functions.numeric import round4
from rubrica.functions.text import profile_text


def label_distribution(df: DataFrame, label: str = "human_score") -> DataFrame:
    """Count and percentage of each label; unlabelled rows are left out."""
    counts = df.groupBy(label).agg(F.count(label).alias("n")).filter(F.col("n") > 0)
    # One row per label is left, so the window over all of them is small.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", round4(F.lit(100.0) * F.col("n") / total))


def exact_match_profile(df: DataFrame) -> DataFrame:
    """Rows whose lightly normalised texts agree: count, total and percentage."""
    same = profile_text(F.col("stimulus")) == profile_text(F.col("transcription"))
    counted = df.agg(F.count("*").alias("total"), F.count_if(same).alias("exact"))
    return counted.select(
        "total",
        "exact",
        (F.col("total") - F.col("exact")).alias("needs_features"),
        F.when(F.col("total") > 0, round4(F.lit(100.0) * F.col("exact") / F.col("total"))).alias(
            "exact_percent"
        ),
    )
