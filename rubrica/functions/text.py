"""Text cleaning and the early gate as column expressions (no Python in the tasks).

Character classes are spelled out because Java's ``\\w``, ``\\b`` and ``\\s`` are ASCII by default:
a word character is a letter, a number or ``_``; white space includes U+001C to U+001F.
"""

from __future__ import annotations

import operator
import re
import string
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.config import CleanConfig
from rubrica.functions.binding import bind

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
SPACES = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())

_NOT_AFTER_WORD, _NOT_BEFORE_WORD = rf"(?<![{WORD}])", rf"(?![{WORD}])"
_AFTER_WORD, _BEFORE_WORD = rf"(?<=[{WORD}])", rf"(?=[{WORD}])"

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


def coerce_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Drop white space at both ends (``trim`` alone would take U+0020 only)."""
    return F.btrim(c, F.lit(SPACES))


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?U)[{SPACE}]+", " "))


def _any_of(patterns: list[str], words: tuple[str, ...]) -> str:
    """Alternation that looks at the first character before trying any pattern."""
    first = "".join(sorted({re.escape(w[0]) for w in words}))
    return f"(?iu)(?=[{first}])(?:{'|'.join(patterns)})"


def remove_noise_tags(c: Column, tags: tuple[str, ...]) -> Column:
    if not tags:
        return c
    return F.regexp_replace(c, _any_of([re.escape(t) for t in tags], tags), " ")


def _bounded(marker: str) -> str:
    """The marker between word boundaries, whichever kind of character it starts or ends with."""
    is_word = [ch.isalnum() or ch == "_" for ch in (marker[0], marker[-1])]
    left = _NOT_AFTER_WORD if is_word[0] else _AFTER_WORD
    right = _NOT_BEFORE_WORD if is_word[1] else _BEFORE_WORD
    return left + re.escape(marker) + right


def remove_gibberish(c: Column, markers: tuple[str, ...]) -> Column:
    if not markers:
        return c
    return F.regexp_replace(c, _any_of([_bounded(m) for m in markers], markers), " ")


def remove_restarts(c: Column) -> Column:
    """``dis- disminuido`` becomes ``disminuido``."""
    return F.regexp_replace(c, rf"(?U){_NOT_AFTER_WORD}[{WORD}]+-[{SPACE}]+{_BEFORE_WORD}", "")


def _may_hold(text: Column, words: tuple[str, ...]) -> Column:
    """False only where no word can occur: none of their first characters does, in either case."""
    first = {w[0] for w in words}
    # These have further case variants, and so may letters beyond ASCII.
    if any(ch in "iksIKS" or (not ch.isascii() and ch.isalpha()) for ch in first):
        return F.lit(True)
    variants = sorted({v for ch in first for v in (ch.lower(), ch.upper())})
    return reduce(operator.or_, [text.contains(v) for v in variants], F.lit(False))


def remove_stutters(c: Column) -> Column:
    """``m- muy`` becomes ``muy``.  After :func:`remove_restarts` there is nothing left to match."""
    return F.regexp_replace(c, rf"(?U){_NOT_AFTER_WORD}[{WORD}]-[{SPACE}]+{_BEFORE_WORD}", "")


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[^{WORD}{SPACE}]", " ")


@lru_cache(maxsize=1)
def _base_letters() -> dict[str, str]:
    """Letters and what is left of their canonical decomposition without its marks.

    Built from the Unicode database; syllable blocks follow a rule of their own.
    """
    base = {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if HANGUL_FIRST <= code <= HANGUL_LAST or not unicodedata.decomposition(ch):
            continue
        parts = unicodedata.normalize("NFD", ch)
        letters = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if letters and letters != ch:
            base[ch] = letters
    return base


def _translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def _decompose_hangul(c: Column) -> Column:
    """Syllable blocks to their letters, by the arithmetic rule of the Unicode standard."""

    def letter(first: int, count: int, index: Column) -> Column:
        return F.lit("".join(chr(first + i) for i in range(count))).substr(index + 1, F.lit(1))

    def split_block(ch: Column) -> Column:
        block = (F.ascii(ch) - HANGUL_FIRST).cast("int")
        lead = (block / 588).cast("int")
        vowel = (block % 588 / 28).cast("int")
        tail = F.when(block % 28 > 0, letter(0x11A8, 27, block % 28 - 1)).otherwise("")
        return F.when(
            ch.between(chr(HANGUL_FIRST), chr(HANGUL_LAST)),
            F.concat(letter(0x1100, 19, lead), letter(0x1161, 21, vowel), tail),
        ).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), split_block), "")


def remove_accents(c: Column) -> Column:
    """Canonical decomposition without the combining marks: ``está`` becomes ``esta``.

    ASCII text is passed through and Latin letters take one look-up each; the full table, marks
    standing alone and syllable blocks are tried only on rows with other scripts.
    """
    table = _base_letters()
    single = {ch: base for ch, base in table.items() if len(base) == 1}
    latin = {ch: base for ch, base in single.items() if ch < "\u0250" or "\u1e00" <= ch <= "\u1eff"}

    several = {ch: base for ch, base in table.items() if len(base) > 1}
    rare = f"[{chr(HANGUL_FIRST)}-{chr(HANGUL_LAST)}{''.join(several)}]"

    def expand(text: Column) -> Column:
        for ch, base in several.items():
            text = F.replace(text, F.lit(ch), F.lit(base))
        return _decompose_hangul(text)

    def all_scripts(text: Column) -> Column:
        out = F.regexp_replace(_translate(text, single), r"\p{Mn}+", "")
        return bind(out, lambda t: F.when(t.rlike(rare), expand(t)).otherwise(t))

    def fold(text: Column) -> Column:
        return (
            F.when(F.length(text) == F.octet_length(text), text)
            .when(text.rlike(r"[^\x00-\u024f\u1e00-\u1eff]"), all_scripts(text))
            .otherwise(_translate(text, latin))
        )

    return bind(c, fold)


def is_effectively_empty(c: Column) -> Column:
    return ~c.rlike(r"[\p{L}\p{N}]")


def clean_text(c: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    """All cleaning rules in their fixed order; text without any letter or number becomes ``""``."""
    out = coerce_text(c)
    if cfg.lowercase:
        out = F.lower(out)

    def without_noise(text: Column) -> Column:
        # Stutters are the one-letter case of restarts, so one pass does both.
        quiet = remove_gibberish(remove_noise_tags(text, cfg.noise_tags), cfg.gibberish_markers)
        suspect = _may_hold(text, (*cfg.noise_tags, *cfg.gibberish_markers, "-"))
        return F.when(suspect, remove_restarts(quiet)).otherwise(text)

    out = bind(out, without_noise)
    if cfg.remove_punctuation:
        # Punctuation becomes a space and spaces are folded: one pass for both rules.
        out = F.regexp_replace(out, rf"[^{WORD}]+", " ")
    if cfg.normalize_accents:
        out = remove_accents(out)
    out = F.trim(out) if cfg.remove_punctuation else normalize_whitespace(out)
    # Empty unless a letter or number is left; as a replacement, so that the chain stays single.
    return F.regexp_replace(out, r"^[^\p{L}\p{N}]*$", "")


def early_gate_score(clean_stimulus: Column, clean_response: Column, normalized: bool = False) -> Column:
    """Score the gate settles: 0 for an empty response (tested first), 4 for an exact match,
    null for a pair that goes on.

    ``normalized`` says that both texts come from :func:`clean_text` and need no second folding.
    """
    stim, resp = clean_stimulus, clean_response
    if not normalized:
        stim = normalize_whitespace(coerce_text(stim))
        resp = normalize_whitespace(coerce_text(resp))
    empty = resp == "" if normalized else is_effectively_empty(resp)
    return F.when(empty, 0).when((stim != "") & (stim == resp), 4)


def early_gate(clean_stimulus: Column, clean_response: Column) -> Column:
    """The gate as 4, 0 or -1 (go on)."""
    return F.coalesce(early_gate_score(clean_stimulus, clean_response), F.lit(-1))


def gate_to_score(gate: Column) -> Column:
    return F.when(gate.isin(0, 4), gate)


def profile_text(c: Column) -> Column:
    """Light form used by the exact-match profile: lower case, ASCII punctuation deleted."""
    return strip(F.translate(F.lower(coerce_text(c)), string.punctuation, ""))
