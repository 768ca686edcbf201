"""Token sets and their overlap as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.config import NUMBER_WORDS
from rubrica.functions.numeric import round4

LEXICAL_FEATURES = (
    "lemma_recall",
    "idea_unit_recall",
    "lemma_precision",
    "idea_unit_precision",
    "stimulus_lemma_count",
    "response_lemma_count",
    "stimulus_idea_count",
    "response_idea_count",
)


# Bare punctuation, digits with signs and separators, and fractions, as whole words.
_DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
_NO_WORD = rf"(?:\p{{P}}+|[+\-±~]?[,.]*[{_DIGIT}][{_DIGIT},.]*|[+\-±~]?\p{{Nd}}+/\p{{Nd}}+)"
_DROPPED = rf"(?=[\p{{P}}\p{{N}}+±~])(?<![^ ]){_NO_WORD}(?![^ ])"


def tokens(text: Column, number_words: tuple[str, ...] = NUMBER_WORDS) -> Column:
    """Distinct words of cleaned text, without bare punctuation and number-like words."""
    words = F.array_distinct(F.split(F.regexp_replace(text, _DROPPED, ""), " "))
    return F.filter(words, lambda word: ~word.isin("", *number_words))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.greatest(whole, F.lit(1))).otherwise(0.0)


def overlap_columns(common: Column, source: Column, target: Column, prefix: str) -> list[Column]:
    """Recall and precision from the sizes of two sets and of what they share."""
    return [
        round4(_share(common, source)).alias(f"{prefix}_recall"),
        round4(_share(common, target)).alias(f"{prefix}_precision"),
    ]


def set_recall(source: Column, target: Column) -> Column:
    return _share(F.size(F.array_intersect(source, target)), F.size(source))


def set_precision(source: Column, target: Column) -> Column:
    return _share(F.size(F.array_intersect(source, target)), F.size(target))
