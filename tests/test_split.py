import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rubrica.config import SplitConfig
from rubrica.operators import split
from rubrica.operators.split import split_labeled, validation_quotas


def table(spark, counts, unlabelled=0):
    labels = [y for y, n in counts.items() for _ in range(n)] + [None] * unlabelled
    return spark.createDataFrame(list(enumerate(labels)), "id long, human_score int")


def expected(rows, quotas, seed=42, strata=True):
    groups = {}
    for r in rows:
        groups.setdefault(r.human_score if strata else 0, []).append(r.id)
    chosen = set()
    for g, ids in groups.items():
        chosen |= set(sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())[: quotas.get(g, 0)])
    return chosen


def test_stratified_sizes_and_members(spark):
    counts = {0: 13, 1: 7, 2: 29, 3: 2, 4: 400}
    df = table(spark, counts, unlabelled=20)
    rows = split_labeled(df, "id").collect()
    assert len(rows) == sum(counts.values())
    quotas = validation_quotas(counts, SplitConfig())
    assert sum(quotas.values()) == math.ceil(sum(counts.values()) * 0.2)
    assert all(abs(quotas[y] - n * 91 / 451) < 1 for y, n in counts.items())
    labelled = [r for r in rows]
    assert {r.id for r in rows if r.split == "validation"} == expected(labelled, quotas)


def test_split_does_not_depend_on_partitions(spark):
    df = table(spark, {0: 50, 4: 200})
    sides = [{(r.id, r.split) for r in split_labeled(df.repartition(n), "id").collect()} for n in (1, 7)]
    assert sides[0] == sides[1]


def test_seed_changes_the_members(spark):
    df = table(spark, {0: 50, 4: 200})
    chosen = [{r.id for r in split_labeled(df, "id", cfg=SplitConfig(seed=s)).collect() if r.split == "validation"} for s in (1, 2)]
    assert chosen[0] != chosen[1] and len(chosen[0]) == len(chosen[1]) == 50


@pytest.mark.parametrize("ranked", [1, 3, 10_000])
def test_intervals_are_narrowed_until_few_rows_are_left(spark, monkeypatch, ranked):
    monkeypatch.setattr(split, "PREFIX", 1)
    monkeypatch.setattr(split, "RANKED_ROWS", ranked)
    sizes, real = [], split._narrowed
    monkeypatch.setattr(split, "_narrowed", lambda *a: sizes.append(real(*a)) or sizes[-1])
    counts = {0: 60, 2: 90, 4: 700}
    rows = split_labeled(table(spark, counts), "id").collect()
    assert {r.id for r in rows if r.split == "validation"} == expected(rows, validation_quotas(counts, SplitConfig()))
    last = {r["_g"]: r["_n"] for found in sizes for r in found}
    assert max(last.values()) <= ranked and (ranked > 700 or len(sizes) > 1)


def test_an_id_with_a_third_of_the_rows_is_not_ranked(spark, monkeypatch):
    """Its prefix never gets short of rows, so the id itself is the cut."""
    monkeypatch.setattr(split, "RANKED_ROWS", 5)
    hot = min(range(300), key=lambda i: abs(int(hashlib.md5(f"42|{i}".encode()).hexdigest(), 16) / 16**32 - 0.1))
    df = table(spark, {4: 300}).withColumn("id", F.when(F.col("id") % 3 == 0, hot).otherwise(F.col("id")))
    rows = split_labeled(df, "id").collect()
    sides = {i: {r.split for r in rows if r.id == i} for i in {r.id for r in rows}}
    assert all(len(s) == 1 for s in sides.values()) and sides[hot] == {"validation"}


def test_labels_outside_the_grades(spark):
    with pytest.raises(ValueError, match="grades"):
        split_labeled(table(spark, {0: 10, 7: 10}), "id")


@pytest.mark.parametrize("counts", [{0: 1, 4: 30}, {0: 2, 1: 2, 2: 2}])
def test_falls_back_to_a_plain_split(spark, counts):
    rows = split_labeled(table(spark, counts), "id").collect()
    n = sum(counts.values())
    assert {r.id for r in rows if r.split == "validation"} == expected(rows, {0: math.ceil(0.2 * n)}, strata=False)


def test_nothing_to_split(spark):
    with pytest.raises(ValueError):
        split_labeled(table(spark, {}, unlabelled=3), "id")
    with pytest.raises(ValueError):
        split_labeled(table(spark, {4: 1}), "id")


def test_quota_ties_go_to_the_lower_label():
    assert validation_quotas({0: 2996, 1: 3020, 2: 3003, 3: 3003, 4: 2978}, SplitConfig()) == {0: 599, 1: 604, 2: 600, 3: 601, 4: 596}


@pytest.mark.parametrize("stratify", [True, False])
def test_splitting_is_a_projection(spark, plan_of, stratify):
    """Counts and one hash prefix are shuffled to find the cuts, the rows themselves never."""
    df = table(spark, {0: 50, 4: 200}).withColumn("wide", F.lit("x"))
    plan = plan_of(split_labeled(df, "id", cfg=SplitConfig(stratify=stratify)))
    assert "Exchange" not in plan and "Join" not in plan


def test_text_ids(spark):
    df = table(spark, {0: 20, 4: 30}).withColumn("id", F.concat(F.lit("r"), "id"))
    rows = split_labeled(df, "id").collect()
    assert {r.id for r in rows if r.split == "validation"} == expected(rows, {0: 4, 4: 6})
