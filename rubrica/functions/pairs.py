"""Class probabilities of a pair model as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.binding import bind
from rubrica.functions.numeric import clamp01, round4, safe_value

NLI_CLASSES = ("entailment", "neutral", "contradiction")
NLI_FEATURES = ("nli_entailment", "nli_neutral", "nli_contradiction", "nli_margin")

# The part of a model's label that tells its class.
LABEL_PARTS = {"entail": "entailment", "neutral": "neutral", "contrad": "contradiction"}


def label_positions(labels: Sequence[str] | Mapping[int, str]) -> dict[str, int]:
    """Position of each of the three classes among a model's labels; other labels are ignored.

    Where several labels name one class the last one counts.
    """
    items = labels.items() if isinstance(labels, Mapping) else enumerate(labels)
    positions: dict[str, int] = {}
    for index, label in items:
        name = str(label).lower().strip()
        found = next((cls for part, cls in LABEL_PARTS.items() if part in name), name)
        if found in NLI_CLASSES:
            positions[found] = int(index)
    return positions


def softmax(logits: Column) -> Column:
    def shifted(values: Column) -> Column:
        return bind(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x.cast("double") - top)))

    def normalized(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(values, lambda x: x / t))

    return bind(bind(logits, shifted), normalized)


def nli_columns(probabilities: Column, positions: Mapping[str, int]) -> list[Column]:
    """The four features; the margin is taken before rounding, an absent class counts 0."""

    def prob(cls: str) -> Column:
        return F.coalesce(F.get(probabilities, F.lit(positions[cls])), F.lit(0.0)) if cls in positions else F.lit(0.0)

    margin = prob("entailment") - prob("contradiction")
    return [
        *[round4(prob(cls)).alias(f"nli_{cls}") for cls in NLI_CLASSES],
        round4(margin).alias("nli_margin"),
    ]


def joint_similarity(score: Column) -> Column:
    """Scalar score of a joint pair model, clamped to [0, 1], 4 decimals."""
    return round4(clamp01(safe_value(score)))
