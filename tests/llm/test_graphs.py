"""Vectors, conversations, components and the pipeline."""

import math
import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from rubrica.llm import chat, embedding_dedup
from rubrica.llm import components as united
from rubrica.llm.components import components

SMALL = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame(
        [(k, v, label, 0, 0) for k, label, v in rows],
        "vec_id bigint, embedding array<float>, label int, n_links int, component_id int",
    )


def linked(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def expected(rows):
    found = brute.cosine_links(rows, embedding_dedup.COSINE)
    return {k: (n, c, k == c) for k, (n, c) in found.items()}


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, 0, [1.0, 0.0]),
        (2, 0, [2.0, 0.0]),
        (3, 0, [1.0, 0.01]),
        (4, 1, [1.0, 0.0]),
        (5, None, [1.0, 0.0]),
        (6, 0, None),
        (7, 0, []),
        (8, 0, [0.0, 0.0]),
        (9, 0, [nan, 1.0]),
        (10, 0, [inf, 1.0]),
        (11, 0, [None, 1.0]),
        (12, 0, [1.0, 0.0, 0.0]),
        (13, 0, [1.0, 0.0]),
        (14, 0, [-1.0, 0.0]),
        (15, 0, [1e-30, 0.0]),
    ]
    assert linked(embedding_dedup.near_duplicates(vectors(spark, rows))) == expected(rows)


@pytest.mark.parametrize("shard", [8192, 150])
def test_clusters_and_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", shard)
    numbers = np.random.default_rng(4)
    rows = []
    for k in range(600):
        v = numbers.normal(size=16)
        if k < 250:
            v = np.arange(16) + numbers.normal(0, 0.4, 16)
        rows.append((k, k % 2, [float(np.float32(x)) for x in v]))
    want = expected(rows)
    got = linked(embedding_dedup.near_duplicates(vectors(spark, rows)))
    true = sum(n for n, _, _ in want.values())
    found = sum(got[k][0] for k in got)
    assert true > 1000 and 0.98 * true <= found <= true
    assert all(got[k][0] <= want[k][0] for k in got)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).isEmpty()


# --- conversations ---------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "hi there"),
    (1, 2, "user", "more"),
    (2, 0, "user", "hello"),
    (2, 1, "assistant", "hi there"),
    (2, 2, "user", "other"),
    (3, 0, "user", "hello"),
    (4, 0, None, None),
    (4, None, "assistant", "\\ <| \\| <\\| <|im_end|>\n<|im_start|>assistant\nx"),
    (5, 1, "assistant", ""),
    (5, 1, "assistant", ""),
    (6, 0, "a\nb\\n<|", "café 🙂"),
    (None, 0, "user", "lost"),
    (7, 0, "user", "hello"),
    (7, 1, "assistant", "hi there"),
    (7, 2, "user", "more"),
    (8, 0, "assistant", "long " * 5000),
]


def turns(spark, rows=TURNS):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn int, role string, text string, node int")


def test_round_trip(spark):
    tree = chat.build(turns(spark))
    got = {r.conv_id: r for r in chat.read_back(tree).collect()}
    by_conv = {}
    order = sorted(TURNS, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
    for conv, _, role, text in order:
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == by_conv
    for k, r in got.items():
        assert list(r.learned) == [text for role, text in by_conv[k] if role == "assistant"]


def test_shared_turns_are_written_once_in_depth_first_order(spark):
    tree = chat.build(turns(spark))
    nodes = {bytes(r.node): r for r in tree.nodes.collect()}
    paths = {}
    for r in tree.paths.collect():
        paths.setdefault(r.conv_id, {})[r.depth] = nodes[bytes(r.node)]
    assert len({bytes(paths[k][0].node) for k in (1, 2, 3, 7)}) == 1
    assert bytes(paths[1][2].node) == bytes(paths[7][2].node) != bytes(paths[2][2].node)
    spans = sorted((r.start, r.start + r.n_tokens) for r in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for path in paths.values():
        above = []
        for depth in sorted(path):
            node = path[depth]
            assert node.position == sum(e - s for s, e in above)
            attended = {t for i in node.attends for t in range(i.start, i.end)}
            assert attended == {t for s, e in above for t in range(s, e)}
            assert not above or node.start >= above[-1][1]
            above.append((node.start, node.start + node.n_tokens))
    for r in nodes.values():
        subtree = [x for x in nodes.values() if any(i.start <= r.start < i.end for i in x.attends)]
        if subtree:
            last = max(x.start + x.n_tokens for x in subtree)
            inside = [x for x in nodes.values() if r.start < x.start < last]
            assert {bytes(x.node) for x in inside} == {bytes(x.node) for x in subtree}


def test_no_conversations(spark):
    assert chat.report(chat.read_back(chat.build(turns(spark, [])))).isEmpty()


# --- components and pipeline -----------------------------------------------------------------


@pytest.mark.parametrize("task_links", [1_000_000, 100])
def test_components(spark, monkeypatch, task_links):
    monkeypatch.setattr(united, "TASK_LINKS", task_links)
    random.seed(6)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    links += [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    random.shuffle(links)
    union = brute.Union()
    for a, b in links:
        if a != b:
            union.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: union.find(x) for x in union.parent}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        ids = set(left)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(r[-1] for r in brute.contamination(rows, items))
    components_left = brute.jaccard_components([r for r in rows if brute.shingles(r[1])])
    assert all(c == k for k, (_, c) in components_left.items())
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == ids
