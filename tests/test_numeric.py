import math
import random

from pyspark.sql import functions as F

from rubrica.functions.numeric import parse_label, parse_number, round4, safe_value


def test_round4_is_pythons_round(spark):
    rng = random.Random(7)
    values = [(2 * k + 1) / 20000 for k in range(10000)]
    values += [-v for v in values[::50]]
    values += [k / 32 for k in range(-64, 65)] + [a / 160 for a in range(160)]
    values += [rng.random() for _ in range(5000)] + [2.67515, 0.28125, 1.00005, 100.0, 33.33335]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", round4(F.col("v")).alias("r")).collect()
    assert [r.v for r in got if r.r != round(r.v, 4)] == []


def test_safe_value(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,), (-0.5,)], "v double")
    assert [r.x for r in rows.select(safe_value(F.col("v")).alias("x")).collect()] == [0, 0, 0, 0, -0.5]


def test_parse(spark):
    cases = {
        "4": (4.0, 4), " 3.9 ": (3.9, 3), "abc": (None, None), None: (None, None), "1d": (None, None),
        "1e0": (1.0, 1), "inf": (math.inf, None), "-Infinity": (-math.inf, None), "nan": (None, None),
        "3\t": (3.0, 3), "\n3": (3.0, 3), "\u00a03": (None, 3), "\u20033 ": (None, 3),
        "": (None, None), ".5": (0.5, 0), "-1.7": (-1.7, -1), "0x1": (None, None), "1e30": (1e30, None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "s string")
    got = rows.select("s", parse_number(F.col("s")).alias("n"), parse_label(F.col("s")).alias("l")).collect()
    assert {r.s: (r.n, r.l) for r in got} == cases
