"""Result tables: writing, reading back and the final report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.sources import versions

# Columns of the final report and the names they get there.
REPORT_COLUMNS = {
    "participant_id": "ID",
    "stimulus": "Target Sentence",
    "transcription": "Student Response",
    "heuristic_pred": "AI Final Grade (0-4)",
    "early_gate_score": "Early Gate Hit",
    "heuristic_raw_score": "Confidence Score (0-1)",
}

# Columns of the audit table.
AUDIT_COLUMNS = (
    "row_index",
    "participant_id",
    "sheet_name",
    "stimulus",
    "transcription",
    "clean_stimulus",
    "clean_response",
    "human_score",
    "early_gate_score",
)


def save_table(
    df: DataFrame, directory: str, name: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> DataFrame:
    """Write a result table as a new version and return it as read back.

    The version before stays what readers see until the write has ended, and its files stay for readers that have
    begun; older ones go.  ``partition_by`` names columns that readers filter by, such as the sheet.
    """
    spark, table = df.sparkSession, f"{directory.rstrip('/')}/{name}"
    options = {"header": True} if fmt == "csv" else {}
    before = versions.newest(spark, table)
    target = versions.following(spark, table)
    df.write.format(fmt).options(**options).partitionBy(*(partition_by or [])).save(target)
    now = versions.newest(spark, table)
    versions.keep_only(spark, table, "version", {str(n) for n in (before, now) if n is not None})
    return spark.read.format(fmt).options(**options).schema(df.schema).load(versions.path(table, now))


def read_table(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """The newest finished version of a result table; raises where there is none."""
    table = f"{directory.rstrip('/')}/{name}"
    number = versions.newest(spark, table)
    if number is None:
        raise FileNotFoundError(f"no finished version of {table}")
    options = {"header": True, "inferSchema": True} if fmt == "csv" else {}
    return spark.read.format(fmt).options(**options).load(versions.path(table, number))


def audit_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Record and feature columns; an absent id column reads ``N/A``."""
    out = df
    for name in ("participant_id", "sheet_name"):
        if name not in df.columns:
            out = out.withColumn(name, F.lit("N/A"))
    return out.select(*AUDIT_COLUMNS, *[f for f in features if f in df.columns])


def validation_predictions(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("row_index").alias("original_row_index"),
        "human_score",
        "early_gate_score",
        "heuristic_pred",
        "ordinal_pred",
        "heuristic_raw_score",
    )


def report_table(predictions: DataFrame) -> DataFrame:
    """The report columns under their report names; raises when one is missing."""
    missing = [c for c in REPORT_COLUMNS if c not in predictions.columns]
    if missing:
        raise ValueError(f"report columns missing: {missing}")
    return predictions.select(*[F.col(c).alias(title) for c, title in REPORT_COLUMNS.items()])
