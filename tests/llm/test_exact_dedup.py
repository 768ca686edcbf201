"""Exact duplicates: groups, bucket directory, colliding keys, odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from rubrica.llm import exact_dedup


def expected(docs):
    groups = defaultdict(list)
    for key, text in docs:
        groups[text or ""].append(key)
    out = Counter()
    for key, text in docs:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out[key, keep, len(ids), key == keep, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


def table(spark, docs):
    return spark.createDataFrame(
        [(k, t, "d", 0, 1) for k, t in docs], "doc_id bigint, text string, digest string, key int, n int"
    )


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


ODD = [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "A"), (6, "a"), (6, "a"), (None, "a"), (None, "b"), (7, "x" * 200_000)]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_odd_rows(spark, bits):
    docs = [*ODD, (8, "x" * 200_000), (9, "x" * 199_999 + "y"), (-5, "é"), (10, "é")]
    assert found(exact_dedup.resolve(table(spark, docs), key_bits=bits)) == expected(docs)


@pytest.mark.parametrize("capacity", [4096, 3])
def test_hot_groups_and_directory(spark, capacity):
    numbers = random.Random(1)
    docs = [(i, "copy" if i % 3 == 0 else f"text {numbers.randrange(700)}") for i in range(1500)]
    assert found(exact_dedup.resolve(table(spark, docs), capacity=capacity)) == expected(docs)


def test_buckets_hold_their_keys(spark):
    docs = table(spark, [(i, f"text {i}") for i in range(3000)])
    index = exact_dedup.build(docs, capacity=20)
    slots = index.directory.collect()
    assert sorted(r.slot for r in slots) == list(range(1 << index.depth))
    per_bucket = index.buckets.groupBy("bucket", "depth").agg(F.countDistinct("key").alias("n")).collect()
    assert sum(r.n for r in per_bucket) == 3000 and max(r.n for r in per_bucket) <= 20
    depths = {r.bucket: r.depth for r in slots}
    for r in per_bucket:
        assert depths[r.bucket] == r.depth
    full = {r.bucket: r.n for r in per_bucket}
    for bucket, depth in depths.items():  # no bucket was split without need
        buddy = bucket ^ (1 << (index.depth - depth)) if depth else None
        if depth and depths.get(buddy) == depth:
            assert full.get(bucket, 0) + full.get(buddy, 0) > 20
    keys = index.buckets.select("bucket", "depth", "key").collect()
    assert all((r.key % (1 << 64)) >> (64 - index.depth) >> (index.depth - r.depth) == r.bucket >> (index.depth - r.depth) for r in keys)


def test_chains_number_colliding_entries(spark):
    index = exact_dedup.build(table(spark, [(i, f"t{i}") for i in range(50)]), key_bits=2)
    rows = index.buckets.collect()
    for key in {r.key for r in rows}:
        chain = sorted(r.place for r in rows if r.key == key)
        assert chain == list(range(1, len(chain) + 1))


def test_normalised_texts_and_kept_rows(spark):
    docs = table(spark, [(1, "A b"), (2, "a b"), (3, "c")])
    decided = exact_dedup.resolve(docs, normalise=F.lower)
    assert {(r.doc_id, r.keep_id, r.kept) for r in decided.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    kept = exact_dedup.kept_rows(docs, decided)
    assert kept.columns == docs.columns or set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_table_and_plan(spark, plan_of):
    assert exact_dedup.resolve(table(spark, [])).count() == 0
    plan = plan_of(exact_dedup.resolve(table(spark, ODD)))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
