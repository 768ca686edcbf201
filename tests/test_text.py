import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rubrica.config import CleanConfig
from rubrica.functions import text as T

CFG = CleanConfig()


def rules(value, cfg=CFG):
    """The cleaning rules, stated with Python's own regular expressions."""
    out = value or ""
    out = out.lower() if cfg.lowercase else out
    if cfg.noise_tags:
        out = re.sub("|".join(map(re.escape, cfg.noise_tags)), " ", out, flags=re.I)
    if cfg.gibberish_markers:
        out = re.sub("|".join(rf"\b{re.escape(m)}\b" for m in cfg.gibberish_markers), " ", out, flags=re.I)
    out = re.sub(r"\b\w+-\s+(?=\w+\b)", "", out)
    out = re.sub(r"\b\w-\s+(?=\w+\b)", "", out)
    out = re.sub(r"[^\w\s]", " ", out) if cfg.remove_punctuation else out
    if cfg.normalize_accents:
        out = "".join(c for c in unicodedata.normalize("NFD", out) if unicodedata.category(c) != "Mn")
    out = re.sub(r"\s+", " ", out).strip()
    return out if re.sub(r"[\W_]+", "", out) else ""


def cleaned(spark, values, cfg=CFG):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.c for r in rows.select("i", T.clean_text(F.col("t"), cfg).alias("c")).orderBy("i").collect()]


GOLDEN = {
    "dis- disminuido": "disminuido",
    "m- muy": "muy",
    "no-dis- m- muy": "no muy",
    "[PAUSE] hola xx": "hola",
    "xxx": "",
    "éx xé": "ex xe",
    "Está el ñandú": "esta el nandu",
    "ratón": "rato n",
    "___": "",
    "...": "",
    None: "",
    "[en inglés] Hello": "hello",
    "x x x y": "y",
    "hola \t mundo\x1c": "hola mundo",
}


def test_golden_cleaning(spark):
    assert dict(zip(GOLDEN, cleaned(spark, list(GOLDEN)))) == GOLDEN


PIECES = st.sampled_from(
    ["[pause]", "[Cough]", "[en inglés]", "xxx", "xx", "x", "X", "dis-", "m- ", "-", " ", "  ", "\t", "\x1c", "\x85",
     "\xa0", "　", "é", "É", "ñ", "ñ", "İ", "ß", "한국", "각", "ö", "_", "__", "!", "¿", "hola", "muy",
     "ratón", "5", "½", "Σ", "ς", "ক", "ো", "ệ", "Å", "日本", "🙂", "K", "'", "Ж", "й"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=200, max_size=400))
def test_cleaning_equals_the_rules(spark, values):
    assert cleaned(spark, values) == [rules(v) for v in values]


@pytest.mark.parametrize(
    "cfg",
    [
        CleanConfig(remove_punctuation=False),
        CleanConfig(normalize_accents=False),
        CleanConfig(lowercase=False, noise_tags=(), gibberish_markers=()),
        CleanConfig(remove_punctuation=False, normalize_accents=False, gibberish_markers=("?!", "eh")),
    ],
)
def test_cleaning_toggles(spark, cfg):
    values = ["Está [PAUSE] x, dis- disminuido!", "a-  b ñ", "ñ É ...", "eh?! qué eh", " \t"]
    assert cleaned(spark, values, cfg) == [rules(v, cfg) for v in values]


def test_every_decomposable_letter_loses_its_marks(spark):
    letters = [
        chr(c) for c in [*range(0xC0, 0x3000), *range(0xAC00, 0xD7A4, 97), *range(0xF900, 0xFB00), *range(0x1D150, 0x1D1D0)]
        if unicodedata.decomposition(chr(c)) or 0xAC00 <= c <= 0xD7A3
    ]
    rows = spark.createDataFrame([(c,) for c in letters], "t string")
    got = {r.t: r.a for r in rows.select("t", T.remove_accents(F.col("t")).alias("a")).collect()}
    want = {
        c: "".join(p for p in unicodedata.normalize("NFD", c) if unicodedata.category(p) != "Mn") for c in letters
    }
    assert got == want


def test_stutters_are_gone_after_restarts(spark):
    values = ["m- muy a- b", "x y- z", "dis- m- a", "é- à l"]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    restarted = T.remove_restarts(F.col("t"))
    for r in rows.select(restarted.alias("a"), T.remove_stutters(restarted).alias("b")).collect():
        assert r.a == r.b
    only = rows.select(T.remove_stutters(F.col("t")).alias("x")).collect()
    assert [r.x for r in only] == ["muy b", "x z", "dis- a", "à l"]


def test_cleaning_is_idempotent(spark):
    values = ["Está el ñandú, ¡qué!", "uno dos", "[pause] hola"]
    once = cleaned(spark, values)
    assert cleaned(spark, once) == once


def test_gate(spark):
    cases = [("", "", 0), ("a", "a", 4), ("a", "b", -1), ("a", "", 0), ("", "b", -1), ("a  b", " a b ", 4), ("a", "_", 0), (None, None, 0)]
    rows = spark.createDataFrame([c[:2] for c in cases], "s string, r string")
    gate = T.early_gate(F.col("s"), F.col("r"))
    got = rows.select(gate.alias("g"), T.gate_to_score(gate).alias("score")).collect()
    assert [r.g for r in got] == [c[2] for c in cases]
    assert [r.score for r in got] == [None if c[2] == -1 else c[2] for c in cases]


def test_profile_text(spark):
    rows = spark.createDataFrame([(" ¡Hola, Mundo! ",), ("it's  a-b",), (None,)], "t string")
    got = [r.x for r in rows.select(T.profile_text(F.col("t")).alias("x")).collect()]
    assert got == ["¡hola mundo", "its  ab", ""]


def test_cleaning_stays_in_the_jvm(spark, plan_of):
    rows = spark.createDataFrame([("a",)], "t string")
    assert "Python" not in plan_of(rows.select(T.clean_text(F.col("t"))))
