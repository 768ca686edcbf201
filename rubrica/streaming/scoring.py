"""Scoring answers as they arrive: the fitted scorers are projections, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rubrica.config import CleanConfig
from rubrica.functions.lexical import LEXICAL_FEATURES
from rubrica.operators.cleaning import preprocess_pairs
from rubrica.operators.features import lexical_features
from rubrica.plans.experiment import Fitted


def score_stream(answers: DataFrame, fitted: Fitted, clean: CleanConfig = CleanConfig()) -> DataFrame:
    """Cleaned, gated and scored answers of a streaming table of pairs.

    Word overlap is computed in the stream; features of models must come with the table.  A stream without
    one that carries weight, or that the fitted models read, is rejected: its scores would mean something else.
    """
    needed = {f for f, weight in fitted.heuristic.normalized_weights.items() if weight}
    needed |= set(fitted.ordinal.config.features)
    missing = sorted(needed - set(LEXICAL_FEATURES) - set(answers.columns))
    if missing:
        raise ValueError(f"the stream lacks features that the scorers use: {missing}")
    overlap = lexical_features(preprocess_pairs(answers, clean), key=[])
    # Settled rows carry no features, as in the batch tables.
    is_open = F.col("early_gate_score").isNull()
    return fitted.score(overlap.withColumns({f: F.when(is_open, F.col(f)) for f in LEXICAL_FEATURES}))


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append scores as Parquet; ``checkpoint`` must be a folder the cluster shares."""
    return (
        scored.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
