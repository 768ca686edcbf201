"""Hard negatives against a plain search over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rubrica.llm import hard_negatives


def expected(rows, k=5, low=80, high=100):
    """rows: (id, label, vector); ids are unique."""
    usable = []
    for key, label, vector in rows:
        if None in (key, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((key, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = set()
    for a, label, x in usable:
        if a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), b, m) for b, m, y in usable if b != a and len(y) == len(x)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, b, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score][:k]
            out |= {(a, b, i, key, score, value) for i, (value, key, _) in enumerate(fits, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame(
        [(k, v, label, 7, "s") for k, label, v in rows],
        "vec_id bigint, embedding array<float>, label int, key int, shard string",
    )


def mined(df, **more):
    found = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect()]
    assert len(found) == len(set(found))
    return set(found)


def cloud(n, width, seed, labels=4):
    numbers = np.random.default_rng(seed)
    centres = numbers.normal(size=(labels, width))
    rows = []
    for i in range(n):
        label = int(numbers.integers(labels))
        rows.append((i, label, (centres[label] + numbers.normal(size=width)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("least", [1 << 18, 300])
def test_clouds(spark, monkeypatch, least):
    monkeypatch.setattr(hard_negatives, "LEAST_NUMBERS", least)  # read on the driver only
    rows = cloud(1200, 6, 1)
    assert mined(table(spark, rows)) == expected(rows)


def test_copies_and_ties(spark):
    rows = cloud(300, 4, 2)
    rows = [(k, label, rows[0][2] if k % 3 else v) for k, label, v in rows]
    assert mined(table(spark, rows)) == expected(rows)


def test_one_label_and_other_windows(spark):
    rows = [(k, 1, v) for k, _, v in cloud(150, 3, 3)]
    assert mined(table(spark, rows)) == set()
    rows = cloud(500, 5, 4)
    assert mined(table(spark, rows), low=50, high=90) == expected(rows, low=50, high=90)


def test_odd_rows(spark):
    rows = cloud(210, 3, 5) + [
        (300, None, [1.0, 1.0, 1.0]),
        (400, 1, None),
        (500, 1, [1.0, None, 1.0]),
        (600, 1, [math.nan, 1.0, 1.0]),
        (700, 1, [math.inf, 1.0, 1.0]),
        (None, 1, [1.0, 1.0, 1.0]),
        (800, 2, []),
        (801, 2, []),
        (802, 3, []),
        (900, 2, [1.0, 2.0]),
        (901, 2, [1.0, 2.0]),
        (902, 3, [1.0, 2.0]),
        (903, 3, [0.0, 0.0]),
        (1000, 0, [0.0, 0.0, 0.0]),
        (1100, -3, [-1.0, -1.0, -1.0]),
    ]
    assert mined(table(spark, rows)) == expected(rows)
    huge = [*rows, (1200, 1, [1e30, 1.0, 1.0])]
    assert mined(table(spark, huge)) == expected(rows)


def test_large_numbers_stay_exact(spark):
    numbers = random.Random(6)
    rows = [(i, i % 2, [float(numbers.randrange(1 << 20)) for _ in range(3)]) for i in range(201)]
    assert mined(table(spark, rows)) == expected(rows)


def test_repeated_ids(spark):
    rows = cloud(205, 3, 7)
    again = rows + rows[:50] + [(k, label + 1, v) for k, label, v in rows[:50]]
    assert mined(table(spark, again)) == expected(rows)


def test_empty_table(spark):
    assert mined(table(spark, [])) == set()


def test_boxes_prune():
    numbers = np.random.default_rng(8)
    centres = numbers.integers(-2000, 2000, size=(40, 3))
    vectors = centres.repeat(200, axis=0) + numbers.integers(-20, 20, size=(8000, 3))
    labels = numbers.integers(0, 3, 8000)
    order = hard_negatives.str_order(vectors, labels)
    assert sorted(order.tolist()) == list(range(8000))
    tree = hard_negatives.Tree(np.arange(8000)[order], labels[order], vectors[order])
    search = hard_negatives.Search(tree, -1, 1, vectors[0])
    scores = vectors @ vectors[0]
    for same in (True, False):
        fits = np.flatnonzero((labels == 1) == same)
        fits = fits[(scores[fits] <= 3_000_000)]
        want = sorted(((int(-scores[i]), int(i)) for i in fits))[:5]
        assert [(-s, i) for s, i in search.best(5, same, high=3_000_000)] == want
    assert len(search.scores) < tree.leaves / 2
