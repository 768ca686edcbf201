"""Near-duplicate vectors: small-world graphs per shard, every shard queried, links verified and united.

Vectors of one label (and width) are dealt to shards of bounded size by a hash.  Each shard gets a hierarchical
navigable small-world graph; every vector queries every shard of its label.  A beam that fills up with hits is
doubled for that query; and for ``AUDITED`` queries of each shard pair the true links are found by
brute force: while recall over them is below ``RECALL``, the beam is doubled for all queries.  A link counts if the
cosine in double precision reaches the threshold.  A shard pair hands on one row per linked vector, with
its number of links and the smallest id of its group there, never a row per link.

Equal vectors are one vector with a multiplicity throughout.  Results for odd input: vectors that are null, empty, zero or
hold null or non-finite components, and rows without label or id, link with nothing; repeated rows count as vectors of their
own; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.components import components
from rubrica.llm.scratch import stored

COSINE = 0.98
NEIGHBOURS = 12
BUILD_BEAM = 40
BEAM = 48
SHARD_ROWS = 8192
AUDITED, RECALL = 512, 0.98


class Graph:
    """A navigable small-world graph over unit vectors (rows)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0
        self.layers: list[np.ndarray] = []
        self.entry = -1

    def build(self) -> Graph:
        n = len(self.vectors)
        levels = (-np.log(1 - np.random.default_rng(n).random(n)) / math.log(NEIGHBOURS)).astype(int)
        for level in range(int(levels.max()) + 1 if n else 0):
            self.layers.append(np.full((n, NEIGHBOURS * (2 if level == 0 else 1)), -1, np.int32))
        top = -1
        for i, level in enumerate(levels.tolist()):
            if top >= 0:
                start = self._descend(self.vectors[i], top, level)
                for k in range(min(level, top), -1, -1):
                    found = self._beam(self.vectors[i], start, BUILD_BEAM, k)
                    chosen = self._diverse([j for _, j in found], [s for s, _ in found], NEIGHBOURS)
                    self.layers[k][i, : len(chosen)] = chosen
                    for j in chosen:
                        self._link(j, i, k)
                    start = [j for _, j in found]
            if level > top:
                top, self.entry = level, i
        return self

    def _descend(self, query: np.ndarray, top: int, level: int) -> list[int]:
        start = [self.entry]
        for k in range(top, level, -1):
            start = [self._beam(query, start, 1, k)[0][1]]
        return start

    def _diverse(self, nodes: list[int], sims: list[float], most: int) -> list[int]:
        """Near nodes that are closer to the new one than to each other; the nearest others fill up."""
        if len(nodes) <= most:
            return nodes
        between = self.vectors[nodes] @ self.vectors[nodes].T
        chosen, others = [], []
        nearest = np.full(len(nodes), -2.0, np.float32)
        for p, sim in enumerate(sims):
            if len(chosen) == most:
                break
            if nearest[p] < sim:
                chosen.append(p)
                np.maximum(nearest, between[p], out=nearest)
            else:
                others.append(p)
        chosen += others[: most - len(chosen)]
        return [nodes[p] for p in chosen]

    def _link(self, node: int, other: int, level: int) -> None:
        row = self.layers[level][node]
        if row[-1] < 0:
            row[int(np.argmax(row < 0))] = other
            return
        nodes = np.append(row, other)
        sims = self.vectors[nodes] @ self.vectors[node]
        order = np.argsort(-sims, kind="stable")
        kept = self._diverse(nodes[order].tolist(), sims[order].tolist(), len(row))
        row[: len(kept)] = kept
        row[len(kept) :] = -1

    def _beam(self, query: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` best nodes that a beam search reaches, best first."""
        self.turn += 1
        turn, seen, rows, vectors = self.turn, self.seen, self.layers[level], self.vectors
        seen[start] = turn
        sims = (vectors[start] @ query).tolist()
        open_nodes, best = [], []
        for s, i in zip(sims, start, strict=True):
            heappush(open_nodes, (-s, i))
            heappush(best, (s, i))
        while len(best) > width:
            heappop(best)
        while open_nodes:
            s, i = heappop(open_nodes)
            if -s < best[0][0] and len(best) >= width:
                break
            near = rows[i]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            for t, j in zip((vectors[near] @ query).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heappush(best, (t, j))
                    heappush(open_nodes, (-t, j))
                elif t > best[0][0]:
                    heapreplace(best, (t, j))
                    heappush(open_nodes, (-t, j))
        return sorted(best, reverse=True)

    def near(self, query: np.ndarray, least: float, width: int) -> np.ndarray:
        """Nodes of at least this similarity; the beam widens while hits fill it."""
        n = len(self.vectors)
        if not n:
            return np.zeros(0, np.int64)
        start = self._descend(query, len(self.layers) - 1, 0)
        while True:
            found = self._beam(query, start, min(width, n), 0)
            hits = [j for s, j in found if s >= least]
            if width >= n or len(hits) < 0.8 * width:
                return np.array(hits, np.int64)
            width *= 2


def _prepared(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Key, label, width, digest and bytes of each vector; digest and bytes are null if it links with nothing."""
    rows = vectors.select(
        F.col(key).alias("key"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )

    def prepare(batches):
        for batch in batches:
            digest, raw, width = [], [], []
            for key_, label_, v in zip(
                batch.column("key").to_pylist(), batch.column("label").to_pylist(), batch.column("vector"), strict=True
            ):
                values = v.values
                x = None
                if key_ is not None and label_ is not None and values is not None and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False) + 0.0
                    if not (len(x) and np.isfinite(x).all() and x.any()):
                        x = None
                width.append(0 if x is None else len(x))
                raw.append(None if x is None else x.tobytes())
                digest.append(None if x is None else hashlib.blake2b(raw[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("label"),
                    pa.array(width, pa.int32()),
                    pa.array(digest, pa.binary()),
                    pa.array(raw, pa.binary()),
                ],
                names=["key", "label", "width", "digest", "raw"],
            )

    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, label {kinds['label']}, width int, digest binary, raw binary"
    return stored(rows.mapInArrow(prepare, schema), "vectors")


def _unit(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _indexed(key, table):
    """One row per shard: its vectors and the layers of its graph."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    raw = table.column("raw").to_pylist()
    width = table.column("width")[0].as_py()
    joined = b"".join(raw[i] for i in order)
    graph = Graph(_unit(joined, width)).build()
    layers = []
    for layer in graph.layers:
        rows = np.flatnonzero((layer >= 0).any(axis=1)).astype(np.int32)
        layers.append({"rows": rows.tobytes(), "links": layer[rows].tobytes()})
    return table.select(["label", "width", "shard"]).slice(0, 1).append_column(
        "ids", pa.array([ids[order].tobytes()], pa.binary())
    ).append_column(
        "weights", pa.array([table.column("n").to_numpy()[order].tobytes()], pa.binary())
    ).append_column("raw", pa.array([joined], pa.binary())).append_column(
        "entry", pa.array([graph.entry], pa.int32())
    ).append_column(
        "layers",
        pa.array([layers], pa.list_(pa.struct([("rows", pa.binary()), ("links", pa.binary())]))),
    )


SHARD = "ids binary, weights binary, raw binary, entry int, layers array<struct<rows:binary,links:binary>>"


def _loaded(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    unit = _unit(row["raw"], width)
    graph = Graph(unit)
    graph.entry = row["entry"]
    for k, layer in enumerate(row["layers"]):
        size = NEIGHBOURS * (2 if k == 0 else 1)
        links = np.full((len(unit), size), -1, np.int32)
        rows = np.frombuffer(layer["rows"], np.int32)
        links[rows] = np.frombuffer(layer["links"], np.int32).reshape(-1, size)
        graph.layers.append(links)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64), unit, graph


def _hits(graph: Graph, there: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``there`` each query links with, the beam widened until the audit passes."""
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(np.int64))
    truth = queries[audited] @ there.T >= least
    found = np.zeros((len(queries), len(there)), dtype=bool)
    single = queries.astype(np.float32)
    beam = BEAM
    while True:
        for i, query in enumerate(single):
            near = graph.near(query, least - 1e-4, beam)
            found[i, near[there[near] @ queries[i] >= least]] = True
        total = truth.sum()
        if beam >= len(there) or (found[audited] & truth).sum() >= RECALL * total:
            return found
        beam *= 2


def _groups(links: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric relation."""
    group = np.full(len(links), -1, np.int64)
    for i in range(len(links)):
        if group[i] >= 0:
            continue
        group[i] = i
        stack = [i]
        while stack:
            near = np.flatnonzero(links[stack.pop()] & (group < 0))
            group[near] = i
            stack += near.tolist()
    return group


def _linked(least: float):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, weights, unit, graph = _loaded(row["one"], row["width"])
                if row["one"]["shard"] == row["two"]["shard"]:
                    links = _hits(graph, unit, unit, least)
                    links |= links.T
                    np.fill_diagonal(links, False)
                    count = links @ weights
                    group = _groups(links)
                    some = np.flatnonzero(count)
                    out = ids[some], count[some], ids[group[some]]
                else:
                    others, their_weights, their_unit, their_graph = _loaded(row["two"], row["width"])
                    across = _hits(graph, unit, their_unit, least).T
                    across |= _hits(their_graph, their_unit, unit, least)
                    every = np.concatenate((ids, others))
                    count = np.concatenate((across @ their_weights, across.T @ weights))
                    n = len(every)
                    links = np.zeros((n, n), dtype=bool)
                    links[: len(ids), len(ids) :] = across
                    links[len(ids) :, : len(ids)] = across.T
                    group = _groups(links)
                    some = np.flatnonzero(count)
                    out = every[some], count[some], every[group[some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in out], names=["id", "n_links", "other"]
                )

    return search


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = COSINE,
) -> DataFrame:
    """Per vector: ``key`` (an integer), n_links, component_id and kept."""
    rows = _prepared(vectors, key, vector, label)
    identity = ["label", "width", "digest"]
    distinct = (
        rows.where("digest is not null")
        .groupBy(*identity)
        .agg(F.min("key").cast("bigint").alias("id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    )
    distinct = stored(distinct, "distinct-vectors")
    shards = distinct.groupBy("label", "width").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards"))
    dealt = distinct.join(F.broadcast(shards), ["label", "width"]) if _few(shards) else distinct.join(
        shards, ["label", "width"]
    )
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"))
    kind = dict(rows.dtypes)["label"]
    index = stored(
        dealt.select("label", "width", "shard", "id", "n", "raw")
        .groupBy("label", "width", "shard")
        .applyInArrow(_indexed, f"label {kind}, width int, shard int, {SHARD}"),
        "graphs",
    )
    inner = ["shard", "ids", "weights", "raw", "entry", "layers"]
    one = index.select("label", "width", F.struct(*inner).alias("one"))
    two = index.select("label", "width", F.struct(*inner).alias("two"))
    pairs = one.join(two, ["label", "width"]).where("one.shard <= two.shard")
    spread = pairs.repartition(F.xxhash64("label", "width", "one.shard", "two.shard"))
    found = stored(
        spread.select("width", "one", "two").mapInArrow(_linked(least), "id bigint, n_links bigint, other bigint"),
        "vector-links",
    )
    counts = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    united = components(found, "id", "other")
    classes = distinct.join(counts, "id", "left").join(united, "id", "left").select(
        *identity,
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    out = rows.select("key", *identity).join(classes, identity, "left")
    component = F.coalesce("component", F.col("key").cast("bigint"))
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("key") == component).alias("kept"),
    )


def _few(shards: DataFrame) -> bool:
    """Whether the labels are few enough to send their shard counts to every task."""
    return shards.count() <= 100_000


def oracle_sql() -> str:
    """The same result by brute force."""
    return (
        "with recursive v as (select vec_id, label, embedding::double[64] as e from embeddings), "
        "links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label "
        f"and a.vec_id <> b.vec_id where array_cosine_similarity(a.e, b.e) >= {COSINE}), "
        "reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a), "
        "part as (select a, min(b) as low from reach group by a), "
        "n as (select a, count(*) as n_links from links group by a) "
        "select v.vec_id, coalesce(n_links, 0) as n_links, least(v.vec_id, coalesce(low, v.vec_id)) as component_id, "
        "v.vec_id = least(v.vec_id, coalesce(low, v.vec_id)) as kept "
        "from v left join n on n.a = v.vec_id left join part on part.a = v.vec_id"
    )
