"""Approach A: weighted sum of features, cut into the rubric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import HeuristicConfig
from rubrica.functions.numeric import clamp01, round4, safe_value


def _value(df: DataFrame, name: str) -> Column:
    return safe_value(F.col(name)) if name in df.columns else F.lit(0.0)


def raw_score(df: DataFrame, cfg: HeuristicConfig = HeuristicConfig()) -> Column:
    """Weighted sum in the order of the weights, clamped to [0, 1], 4 decimals."""
    total = F.lit(0.0)
    for name, weight in cfg.normalized_weights.items():
        total = total + _value(df, name) * F.lit(weight)
    return round4(clamp01(total))


def contributions(df: DataFrame, cfg: HeuristicConfig = HeuristicConfig()) -> dict[str, Column]:
    return {
        name: round4(_value(df, name) * F.lit(weight)) for name, weight in cfg.normalized_weights.items()
    }


def to_rubric(raw: Column, cuts: Sequence[float]) -> Column:
    """Class by cut points; a score on a cut point goes up."""
    out = F.when(raw < F.lit(cuts[0]), 0)
    for grade, cut in enumerate(cuts[1:], start=1):
        out = out.when(raw < F.lit(cut), grade)
    return out.otherwise(len(cuts))


def heuristic_score(
    df: DataFrame, cfg: HeuristicConfig = HeuristicConfig(), cuts: Sequence[float] | None = None
) -> DataFrame:
    """Add ``heuristic_raw_score`` and ``heuristic_pred``; a gate score overrides the prediction.

    Rows the gate settled carry no features, so their raw score is 0.
    """
    scored = df.withColumn("heuristic_raw_score", raw_score(df, cfg))
    rubric = to_rubric(F.col("heuristic_raw_score"), cuts or cfg.thresholds)
    return scored.withColumn("heuristic_pred", F.coalesce(_gate(df), rubric).cast("int"))


def _gate(df: DataFrame) -> Column:
    gate = F.col("early_gate_score") if "early_gate_score" in df.columns else F.lit(None)
    return F.when(gate.isin(0, 4), gate.cast("int"))


def score_details(
    df: DataFrame, cfg: HeuristicConfig = HeuristicConfig(), cuts: Sequence[float] | None = None
) -> DataFrame:
    """Add ``details``: prediction, raw score, reason, weights, contributions and inputs.

    For a row the gate settled the raw score is null and the contributions are empty.
    """
    parts = contributions(df, cfg)
    named = df.withColumns({f"_part_{name}": part for name, part in parts.items()})
    scored = heuristic_score(named, cfg, cuts)
    settled = _gate(df).isNotNull()

    def as_map(values: dict[str, Column]) -> Column:
        return F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v)])

    empty = F.create_map().cast("map<string,double>")
    details = F.struct(
        F.col("heuristic_pred").alias("predicted_score"),
        F.when(~settled, F.col("heuristic_raw_score")).alias("raw_continuous_score"),
        F.when(settled, "early_gate_override").alias("reason"),
        as_map({n: F.lit(w) for n, w in cfg.normalized_weights.items()}).alias("applied_weights"),
        F.when(settled, empty)
        .otherwise(as_map({n: F.col(f"_part_{n}") for n in parts}))
        .alias("feature_contributions"),
        as_map({n: (F.col(n) if n in df.columns else F.lit(None)).cast("double") for n in parts}).alias(
            "input_features"
        ),
    )
    return scored.select(*df.columns, details.alias("details"))
