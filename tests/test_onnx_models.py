"""Engines on tiny exported models, written byte by byte so that no model file is needed."""

import struct

import numpy as np
import pytest

from rubrica.operators import features

pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")

from rubrica.sources.onnx_models import onnx_embedder, onnx_pair_model  # noqa: E402

WORDS = ["[PAD]", "[UNK]", "la", "casa", "roja", "perro"]


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def number(field, value):
    return varint(field << 3) + varint(value)


def part(field, value):
    value = value.encode() if isinstance(value, str) else value
    return varint(field << 3 | 2) + varint(len(value)) + value


def value_info(name, kind, dims):
    shape = b"".join(part(1, part(2, d)) for d in dims)
    return part(1, name) + part(2, part(1, number(1, kind) + part(2, shape)))


def model_bytes(table, mean):
    """Rows of ``table`` by token id, and with ``mean`` their mean over the tokens."""
    floats, ints = 1, 7
    tensor = b"".join(number(1, d) for d in table.shape) + number(2, floats) + part(8, "table")
    tensor += part(9, struct.pack(f"<{table.size}f", *table.ravel()))
    out = "states"
    nodes = part(1, part(1, "table") + part(1, "input_ids") + part(2, out) + part(4, "Gather"))
    if mean:
        axes = part(5, part(1, "axes") + number(8, 1) + number(20, 7))
        keep = part(5, part(1, "keepdims") + number(3, 0) + number(20, 2))
        nodes += part(1, part(1, out) + part(2, "logits") + part(4, "ReduceMean") + axes + keep)
        out = "logits"
    graph = nodes + part(2, "g") + part(5, tensor)
    graph += part(11, value_info("input_ids", ints, ["b", "t"]))
    graph += part(12, value_info(out, floats, ["b", "w"] if mean else ["b", "t", "w"]))
    return number(1, 8) + part(8, number(2, 13)) + part(7, graph)


@pytest.fixture
def files(tmp_path):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(len(WORDS), 3)).astype(np.float32)
    words = tokenizers.Tokenizer(
        tokenizers.models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]")
    )
    words.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "encoder.onnx").write_bytes(model_bytes(table, mean=False))
    (tmp_path / "pairs.onnx").write_bytes(model_bytes(table, mean=True))
    return tmp_path, table


def pairs(spark):
    rows = [("la casa roja", "la casa"), ("perro", "gato"), ("la", "la perro roja casa")]
    return spark.createDataFrame(rows, "clean_stimulus string, clean_response string")


def ids(text):
    return [WORDS.index(w) if w in WORDS else 1 for w in text.split()]


def test_encoder(spark, files):
    folder, table = files
    embedder = onnx_embedder(str(folder / "encoder.onnx"), str(folder / "tokenizer.json"))
    for r in features.vector_similarity(pairs(spark), embedder).collect():
        a, b = (table[ids(t)].mean(axis=0) for t in (r.clean_stimulus, r.clean_response))
        expected = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        assert abs(r.sbert_similarity - min(1.0, max(0.0, expected))) < 1e-4


def test_pair_classifier(spark, files):
    folder, table = files
    labels = ["entailment", "neutral", "contradiction"]
    # One pair at a time: this model, unlike a real one, averages over padding too.
    model = onnx_pair_model(str(folder / "pairs.onnx"), str(folder / "tokenizer.json"), labels, batch_size=1)
    for r in features.nli_features(pairs(spark), model).collect():
        logits = table[ids(r.clean_stimulus) + ids(r.clean_response)].mean(axis=0).astype(float)
        p = np.exp(logits) / np.exp(logits).sum()
        assert abs(r.nli_entailment - p[0]) < 1e-4 and abs(r.nli_margin - (p[0] - p[2])) < 1e-4


def test_texts_longer_than_the_model_count_whole(spark, files):
    folder, _ = files
    paths = str(folder / "encoder.onnx"), str(folder / "tokenizer.json")
    base, tail = "la casa " * 200, "perro roja perro " * 40
    rows = [(base, base), (base, base + tail), (base + "roja " * 90, base)]
    long = spark.createDataFrame(rows, "clean_stimulus string, clean_response string")
    embedder = onnx_embedder(*paths, max_length=128)
    got = {(r.clean_stimulus, r.clean_response): r.sbert_similarity for r in features.vector_similarity(long, embedder).collect()}
    assert got[rows[0]] == 1 and got[rows[1]] < 1 and got[rows[2]] < 1
    model = onnx_pair_model(
        str(folder / "pairs.onnx"), paths[1], ["entailment", "neutral", "contradiction"], max_length=256, batch_size=1
    )
    scored = {(r.clean_stimulus, r.clean_response): r.nli_entailment for r in features.nli_features(long, model).collect()}
    assert len(set(scored.values())) == 3


def test_a_text_of_a_million_words_is_many_rows(spark, files, plan_of):
    """Its windows are dealt to tasks, the pooling is an aggregate outside Python."""
    folder, table = files
    embedder = onnx_embedder(str(folder / "encoder.onnx"), str(folder / "tokenizer.json"), max_length=512, batch_size=64)
    words = np.random.default_rng(2).choice(["la", "casa", "roja", "perro"], 1_000_000)
    texts = spark.createDataFrame([(bytearray(b"x"), " ".join(words)), (bytearray(b"y"), "la casa")], "id binary, text string")
    out = embedder(texts)
    plan = plan_of(out)
    assert plan.index("ObjectHashAggregate") < plan.index("MapInPandas") and "Exchange RoundRobinPartitioning" in plan
    got = {bytes(r.id): np.array(r.vector) for r in out.collect()}
    whole = table[[WORDS.index(w) for w in words]].astype(float).mean(axis=0)
    assert np.abs(got[b"x"] - whole / np.linalg.norm(whole)).max() < 0.02  # overlaps count twice
    short = table[ids("la casa")].mean(axis=0)
    assert np.allclose(got[b"y"], short / np.linalg.norm(short), atol=1e-5)


def test_windows_cover_the_text(files):
    from rubrica.sources.onnx_models import _Runner

    folder, _ = files
    runner = _Runner(str(folder / "encoder.onnx"), str(folder / "tokenizer.json"), 10, 4)
    words = [f"w{i}" for i in range(57)]
    windows = [w.split() for w in runner.windows(" ".join(words))]
    assert all(len(w) <= 10 for w in windows)
    assert [w for i, w in enumerate(words) if not any(w in x for x in windows)] == []
    assert all(set(a) & set(b) for a, b in zip(windows, windows[1:]))
