"""Quality classifier: attention over the passages of a document, learned from document labels.

A document is a bag of passages of 64 words.  Every passage is encoded from its text alone: frequencies of
pairs of character classes, word lengths, distinct and repeated words.  A hidden layer embeds the
passage, a gated attention layer (tanh times sigmoid) weighs it among the passages of its document, and
the weighted mean of the embeddings gives the score.  Only document labels train all layers.

The fit uses at most ``TRAIN_DOCS`` labelled documents, taken by hash of their id, and of each at most
``TRAIN_PASSAGES`` passages, evenly spaced; scoring reads every passage of every text.  Label tables, language,
source and id are never inputs of a score.

Results for odd input: a null or empty text is one passage without characters and gets a score; labels that
are null are left out, several labels of a document are averaged; without labels of both kinds every
score is the mean label (0.5 without labels); repeated documents give one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.textblocks import NOT_SPACE, range_hashes, range_sums, text_blocks, word_bounds

PASSAGE_WORDS = 64
TRAIN_DOCS = 3000
TRAIN_PASSAGES = 48
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.01, 1e-4
SEED = 7


def _character_classes() -> np.ndarray:
    table = np.full(256, 15, np.int64)
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 13
    for number, characters in ((3, " "), (4, "\n\r"), (5, "."), (6, ","), (7, "'\"-"), (8, "!?"), (9, ":;"),
                               (10, "()[]{}<>"), (11, "|\\/"), (12, "%$#&*@^~+=_`"), (14, "\t")):
        table[list(characters.encode())] = number
    return table


CLASSES = _character_classes()
N_CLASSES = 16
N_FEATURES = N_CLASSES * N_CLASSES + 5


def encode_passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block of texts, and the first passage of each text."""
    starts, ends, first = word_bounds(data, bounds, NOT_SPACE)
    words = np.diff(first)
    per_row = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_passage = np.concatenate(([0], np.cumsum(per_row)))
    total = int(first_passage[-1])
    row = np.repeat(np.arange(len(words)), per_row)
    nth = np.arange(total) - first_passage[row]
    begin = bounds[:-1][row].copy()
    later = nth > 0
    begin[later] = starts[first[row[later]] + nth[later] * PASSAGE_WORDS]
    sizes = np.diff(np.concatenate((begin, [len(data)])))
    features = np.zeros((total, N_FEATURES), np.float32)
    kinds = CLASSES[data]
    owner = np.repeat(np.arange(total), sizes)
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        code = owner[1:] * (N_CLASSES * N_CLASSES) + kinds[:-1] * N_CLASSES + kinds[1:]
        pairs = np.bincount(code[same], minlength=total * N_CLASSES * N_CLASSES)
        pairs = pairs.reshape(total, -1)
        features[:, : N_CLASSES * N_CLASSES] = np.sqrt(pairs / np.maximum(1, sizes - 1)[:, None])
    if len(starts):
        of_word = np.repeat(np.arange(len(words)), words)
        passage = first_passage[of_word] + (np.arange(len(starts)) - first[of_word]) // PASSAGE_WORDS
        count = np.bincount(passage, minlength=total)
        some = np.maximum(1, count)
        length = np.bincount(passage, ends - starts, minlength=total) / some
        hashes = range_hashes(range_sums(data), starts, ends)
        key = np.sort(passage.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=total) / some
        again = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        repeats = np.bincount(passage[1:][again], minlength=total) / some
        extra = (np.log1p(count) / 4, length / 8, distinct, repeats, count < PASSAGE_WORDS / 2)
        for k, values in enumerate(extra):
            features[:, N_CLASSES * N_CLASSES + k] = values
    return features, first_passage


def _forward(p: dict, x: np.ndarray, first: np.ndarray):
    sizes = np.diff(np.concatenate((first, [len(x)])))
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    weight = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(weight[:, None] * h, first)
    score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
    return score, (sizes, h, t, s, weight, z)


def _gradient(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    score, (sizes, h, t, s, weight, z) = _forward(p, x, first)
    out = (score - y) / len(y)
    dz = out[:, None] * p["c"]
    dz_rows = np.repeat(dz, sizes, axis=0)
    along = (dz_rows * h).sum(1)
    de = weight * (along - np.repeat(np.add.reduceat(weight * along, first), sizes))
    dt, ds = de[:, None] * p["a"] * s, de[:, None] * p["a"] * t
    dt, ds = dt * (1 - t * t), ds * s * (1 - s)
    dh = (dz_rows * weight[:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
    return {
        "w": x.T @ dh + DECAY * p["w"],
        "b": dh.sum(0),
        "v": h.T @ dt,
        "u": h.T @ ds,
        "a": (t * s).T @ de,
        "c": z.T @ out + DECAY * p["c"],
        "d": out.sum(),
    }


def train(bags: list[np.ndarray], labels: np.ndarray) -> dict:
    """Parameters fitted to bags of encoded passages and one label per bag."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    every = np.concatenate(bags).astype(np.float64)
    mean, spread = every.mean(0), every.std(0)
    spread = np.where(spread > 1e-6, np.maximum(spread, 0.02), 1.0)
    bags = [(b - mean) / spread for b in bags]
    random = np.random.default_rng(SEED)
    p = {
        "w": random.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "v": random.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "u": random.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "a": random.normal(0, ATTENTION**-0.5, ATTENTION),
        "c": random.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.float64(0),
    }
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(len(bags))
        for at in range(0, len(bags), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.cumsum([0, *(len(bags[i]) for i in chosen[:-1])])
            gradient = _gradient(p, x, first, y[chosen])
            step += 1
            for k, g in gradient.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "spread": spread}


def held_out(key: str) -> Column:
    """Documents whose labels the fit never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> dict:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    sample = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("key"))
        .agg(F.avg(F.col(label).cast("double")).alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(TRAIN_DOCS)
    )
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "key")

    def encode(batches):
        for batch in batches:
            packed = []
            for _, _, data, bounds in text_blocks(batch.column("text")):
                features, first = encode_passages(data, bounds)
                for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    take = np.unique(np.linspace(s, e - 1, min(TRAIN_PASSAGES, e - s)).astype(np.int64))
                    packed.append(features[take].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(packed, pa.binary())],
                names=["key", "label", "bag"],
            )

    kind = dict(chosen.dtypes)["key"]
    rows = chosen.mapInArrow(encode, f"key {kind}, label double, bag binary").collect()
    rows.sort(key=lambda r: (r["key"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, N_FEATURES) for r in rows]
    return train(bags, np.array([r["label"] for r in rows]))


def _scores(p: dict, texts: pa.Array):
    """Score, number of passages and most attended passage of each text."""
    scores, counts, tops = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, data, bounds in text_blocks(texts):
        features, first = encode_passages(data, bounds)
        counts.append(np.diff(first))
        if "constant" in p:
            scores.append(np.full(len(first) - 1, p["constant"]))
            tops.append(np.zeros(len(first) - 1, np.int64))
            continue
        got, inner = _forward(p, (features - p["mean"]) / p["spread"], first[:-1])
        weight, sizes = inner[4], inner[0]
        at = np.flatnonzero(np.repeat(np.maximum.reduceat(weight, first[:-1]), sizes) == weight)
        owner = np.searchsorted(first, at, "right") - 1
        scores.append(got)
        tops.append(at[np.searchsorted(owner, np.arange(len(sizes)))] - first[:-1])
    return np.concatenate(scores), np.concatenate(counts), np.concatenate(tops)


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, score, n_passages and the passage with the largest attention.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def apply(batches):
        for batch in batches:
            columns = (pa.array(x) for x in _scores(shared.value, batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns], names=["key", "score", "n_passages", "top_passage"]
            )

    kind = dict(texts.dtypes)["key"]
    schema = f"key {kind}, score double, n_passages bigint, top_passage bigint"
    return texts.mapInArrow(apply, schema).withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: dict, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(text))[0] >= least))

    return docs.mapInArrow(apply, docs.schema)


def report(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    return scored.select(
        key,
        held_out(key).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_passages",
        "top_passage",
    )
