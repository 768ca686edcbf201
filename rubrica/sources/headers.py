"""Free-form column headers to the fields of a pair table (schema work, no data)."""

from __future__ import annotations

from collections.abc import Iterable

# Header names and parts of names that mean one of the three fields.
EXACT_HEADERS = {
    "stimulus": {"stimulus", "target", "prompt", "sentence", "source sentence"},
    "transcription": {"transcription", "response", "student response", "student transcription"},
    "human_score": {"score", "human score", "rater score", "rubric score", "grade"},
}
HEADER_PARTS = {
    "stimulus": ("stimulus", "target", "prompt"),
    "transcription": ("transcription", "response", "student"),
    "human_score": ("score", "rubric", "grade"),
}

# Names of the label column of a standardised table.
SCORE_COLUMNS = {
    "score",
    "human score",
    "human_score",
    "ortega score",
    "human grade",
    "grade",
    "final score",
    "rater score",
}


def field_of(header: object) -> tuple[str, bool] | None:
    """The field a header stands for and whether by its exact name; fields in fixed order."""
    if not isinstance(header, str):
        return None
    name = header.lower().strip()
    for field, exact in EXACT_HEADERS.items():
        if name in exact or any(part in name for part in HEADER_PARTS[field]):
            return field, name in exact
    return None


def map_headers(headers: Iterable[object]) -> dict[str, str]:
    """Field to header, the leftmost header winning when several stand for one field.

    A text field prefers an exact name (``Transcription`` over an earlier ``Student ID``);
    for the score the leftmost header wins whatever its kind.
    """
    found: dict[str, tuple[str, bool]] = {}
    for header in headers:
        match = field_of(header)
        if match is None:
            continue
        field, exact = match
        replaces = field != "human_score" and exact and not found.get(field, (None, True))[1]
        if field not in found or replaces:
            found[field] = (header, exact)
    return {field: header for field, (header, _) in found.items()}


def detect_score_column(columns: Iterable[object]) -> str | None:
    """The label column: first exact name, else first name with ``score`` or ``grade`` in it."""
    cleaned = [(col, str(col).strip().lower()) for col in columns]
    exact = [col for col, name in cleaned if name in SCORE_COLUMNS]
    partial = [col for col, name in cleaned if "score" in name or "grade" in name]
    return next(iter(exact + partial), None)
