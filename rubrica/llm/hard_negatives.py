"""Hard negatives of anchor vectors by best-first search in STR-packed R-trees.

Vectors become integers, ``floor(scale * x)``; a score is the exact inner product.  Rows are dealt by label and first
coordinate to shards of bounded size (ranges that end with the id, so that many equal vectors spread).  A shard
is packed by sort-tile-recursive: its coordinates of largest spread, the label first, cut it into slabs, these into tiles, and
so on down to leaves; boxes of leaves, and of boxes, hold the least and the greatest value of every coordinate and label.  The
packed order is stored once.  A box gives an interval that holds the inner product of the query with every
vector inside.  The queue takes the box with the highest possible score inside the window first; boxes outside
the window, or without a fitting label, or strictly below the k-th score found are not opened.

Two searches visit every shard: the best rows of the anchor's label (positives), then for each of them the best
rows of other labels in its score window.  Shards return at most ``k`` rows a search, ranked across shards by a window that Spark
limits before the shuffle.  Shards are read by one task each, ahead of the anchors, which stream past.

Results for odd input: rows without id, label or vector, with null or non-finite components, or so long that inner
products could leave 64 bits (squared length of the integers 2**62 or more) take no part; of rows that repeat an id the one with
the smallest label, then vector, counts; vectors of different width never meet, empty ones score 0 among each other; ties go to
the smaller id; anchors without positives or negatives give no rows; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.scratch import stored

LEAF, FANOUT = 128, 16
#: Coordinates that cut a shard.
CUTS = 3
#: Numbers in a shard at most, and at least while there are fewer shards than cores.
SHARD_NUMBERS, LEAST_NUMBERS = 1 << 24, 1 << 18
#: Whole numbers below this are exact in double precision.
EXACT = 2.0**52
NO_LIMIT = 1 << 62


def str_order(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Row order of the packed leaves: consecutive runs of LEAF rows are tiles."""
    spread = np.argsort(-vectors.astype(float).var(axis=0), kind="stable")[:CUTS] if vectors.size else []
    columns = [vectors[:, c] for c in spread]
    if len(labels) and labels.min() != labels.max():
        columns = [labels, *columns][:CUTS]

    def tiled(rows: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or not rest:
            return [rows]
        rows = rows[np.argsort(rest[0][rows], kind="stable")]
        slabs = int(np.ceil(leaves ** (1 / len(rest))))
        size = -(-leaves // slabs) * LEAF
        return [part for k in range(0, len(rows), size) for part in tiled(rows[k : k + size], rest[1:])]

    return np.concatenate(tiled(np.arange(len(labels)), columns))


class Tree:
    """An R-tree over rows in packed order."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.keys, self.labels, self.integers = keys, labels, vectors
        low = high = np.concatenate((vectors.astype(np.int64), labels[:, None]), axis=1)
        self.first, step = [], LEAF
        lows, highs, sizes = [], [], []
        while True:  # leaves first, the root last
            starts = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            lows.append(low)
            highs.append(high)
            sizes.append(len(low))
            if len(low) == 1:
                break
            step = FANOUT
        self.level_start = np.concatenate(([0], np.cumsum(sizes))).tolist()
        low, high = np.concatenate(lows), np.concatenate(highs)
        self.label_low, self.label_high = low[:, -1].tolist(), high[:, -1].tolist()
        self.low, self.high = low[:, :-1], high[:, :-1]
        self.root, self.leaves = len(low) - 1, sizes[0]
        corner = np.maximum(np.abs(self.low), np.abs(self.high)).astype(float)
        self.reach = float(np.sqrt((corner**2).sum(axis=1).max())) if corner.size else 0.0
        self.cast = {}

    def exact(self, length: float):
        """Vectors and boxes as numbers whose products with a query of that length are exact."""
        kind = np.float64 if self.reach * length < EXACT else object
        if kind not in self.cast:
            self.cast[kind] = tuple(x.astype(kind) for x in (self.integers, self.low, self.high))
        return kind, *self.cast[kind]

    def children(self, node: int) -> range:
        level = next(k for k in range(len(self.level_start) - 1) if node < self.level_start[k + 1])
        below, start = self.level_start[level - 1], node - self.level_start[level]
        return range(below + start * FANOUT, min(below + (start + 1) * FANOUT, self.level_start[level]))


class Search:
    """All searches of one anchor in one tree."""

    def __init__(self, tree: Tree, key: int, label: int, vector: np.ndarray):
        self.tree, self.key, self.label = tree, key, label
        kind, self.vectors, low, high = tree.exact(float(np.sqrt((vector.astype(float) ** 2).sum())))
        self.query = vector.astype(kind)
        up, down = np.maximum(self.query, 0), np.minimum(self.query, 0)
        self.most = (high @ up + low @ down).tolist()
        self.least = (low @ up + high @ down).tolist()
        self.scores: dict[int, np.ndarray] = {}

    def _leaf(self, node: int) -> tuple[slice, np.ndarray]:
        rows = slice(node * LEAF, (node + 1) * LEAF)
        if node not in self.scores:
            self.scores[node] = (self.vectors[rows] @ self.query).astype(np.int64)
        return rows, self.scores[node]

    def best(self, k: int, same: bool, low: int = -NO_LIMIT, high: int = NO_LIMIT) -> list[tuple[int, int]]:
        """(score, id) of the best ``k`` rows of the anchor's label, or of other ones, with a score in the window."""
        tree, most, least, label = self.tree, self.most, self.least, self.label
        found: list[tuple[int, int]] = []
        queue = [(-min(most[tree.root], high), tree.root)]
        while queue:
            bound, node = heappop(queue)
            if len(found) == k and -bound < found[0][0]:
                break
            if node >= tree.leaves:
                for child in tree.children(node):
                    if most[child] < low or least[child] > high:
                        continue
                    first, last = tree.label_low[child], tree.label_high[child]
                    if (first <= label <= last) if same else not first == last == label:
                        heappush(queue, (-min(most[child], high), child))
                continue
            rows, scores = self._leaf(node)
            fits = (scores >= (found[0][0] if len(found) == k else low)) & (scores <= high)
            fits &= (tree.labels[rows] == label) if same else (tree.labels[rows] != label)
            places = np.flatnonzero(fits)
            if not len(places):
                continue
            keys = tree.keys[rows][places]
            scores = scores[places]
            if len(places) > k:
                order = np.lexsort((keys, -scores))[: k + 1]  # one more: the anchor itself may be among them
                keys, scores = keys[order], scores[order]
            for score, key in zip(scores.tolist(), keys.tolist(), strict=True):
                if key == self.key:
                    continue
                if len(found) < k:
                    heappush(found, (score, -key))
                elif (score, -key) > found[0]:
                    heapreplace(found, (score, -key))
        return sorted(((score, -key) for score, key in found), key=lambda x: (-x[0], x[1]))


def _rows(batch: pa.RecordBatch):
    """Ids, labels, widths and the vectors' numbers one after the other, with the start of each."""
    column = batch.column(batch.schema.get_field_index("vector"))
    widths = np.diff(column.offsets.to_numpy())
    numbers = column.flatten().to_numpy(zero_copy_only=False)
    named = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "label")}
    return named["key"], named["label"], widths, numbers, np.concatenate(([0], np.cumsum(widths)))


def _packed(batches):
    """The rows of a task, which is a shard, in packed order."""
    parts = [_rows(batch) for batch in batches if batch.num_rows]
    if not parts:
        return
    shard = TaskContext.get().partitionId()
    keys, labels, widths = (np.concatenate([p[i] for p in parts]) for i in range(3))
    numbers = np.concatenate([p[3] for p in parts])
    starts = np.concatenate(([0], np.cumsum(widths)))
    place = 0
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        vectors = numbers[starts[rows][:, None] + np.arange(width)]
        order = str_order(vectors, labels[rows])
        for k in range(0, len(order), 4096):
            some = order[k : k + 4096]
            offsets = pa.array(np.arange(len(some) + 1) * width, pa.int32())
            values = pa.array(vectors[some].ravel(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), shard, np.int32)),
                    pa.array(place + np.arange(len(some))),
                    pa.array(keys[rows][some]),
                    pa.array(labels[rows][some]),
                    pa.ListArray.from_arrays(offsets, values),
                ],
                names=["shard", "place", "key", "label", "vector"],
            )
            place += len(some)


def _searching(visit, names: list[str]):
    """A task function: shards in packed order, each followed by its anchors; ``visit`` gives an anchor's result rows."""

    def run(batches):
        shard, parts, trees = None, [], None
        for batch in batches:
            shards, anchors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "anchor"))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(anchors) != 0)) + 1
            out = []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
                if start == end:
                    continue
                if shards[start] != shard:
                    shard, parts, trees = shards[start], [], None
                part = batch.slice(start, end - start)
                if not anchors[start]:
                    parts.append(_rows(part))
                    continue
                if trees is None:
                    trees = _trees(parts)
                    parts = []
                keys, labels, widths, numbers, starts = _rows(part)
                more = {c: part.column(c).to_pylist() for c in ("positives", "scores")}
                for i, (key, width) in enumerate(zip(keys.tolist(), widths.tolist(), strict=True)):
                    if width in trees:
                        search = Search(trees[width], key, labels[i], numbers[starts[i] : starts[i + 1]])
                        out += visit(search, more["positives"][i], more["scores"][i])
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _trees(parts) -> dict[int, Tree]:
    if not parts:
        return {}
    keys, labels, widths = (np.concatenate([p[i] for p in parts]) for i in range(3))
    numbers = np.concatenate([p[3] for p in parts])
    starts = np.concatenate(([0], np.cumsum(widths)))
    trees = {}
    for width in np.unique(widths).tolist():  # rows of a width are neighbours, in packed order
        rows = np.flatnonzero(widths == width)
        vectors = numbers[starts[rows][:, None] + np.arange(width)]
        trees[width] = Tree(keys[rows], labels[rows], vectors)
    return trees


def _visited(index: DataFrame, anchors: DataFrame, shards: int, visit, names: list[str]) -> DataFrame:
    """Every anchor against every shard."""
    no = F.lit(None).cast("array<bigint>")
    if "scores" not in anchors.columns:
        anchors = anchors.withColumns({"positives": no, "scores": no})
    rows = index.withColumns({"anchor": F.lit(False), "positives": no, "scores": no})
    queries = anchors.withColumns(
        {"anchor": F.lit(True), "place": F.col("key"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}
    )
    together = rows.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "anchor", "place")
    return together.mapInArrow(_searching(visit, names), ", ".join(f"{name} bigint" for name in names))


def _best(df: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """Per anchor (rows where ``anchor``, a condition on the key column, holds), positive and rank: the negative and both scores.

    A negative's score is within ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    numbers = F.transform(F.col(vector), lambda x: F.lit(float(scale)) * x.cast("double"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate("x", F.lit(0.0), lambda total, x: total + (F.abs(x) + 1) * (F.abs(x) + 1))
    rows = (
        vectors.where(anchor.isNotNull() & F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
        .select(
            F.col(key).cast("bigint").alias("key"),
            F.col(label).cast("bigint").alias("label"),
            numbers.alias("x"),
            anchor.alias("is_anchor"),
        )
        .where(~odd & (length < 2.0**62))
        .select("key", "is_anchor", F.struct("label", F.transform("x", lambda x: F.floor(x).cast("int")).alias("vector")).alias("row"))
    )
    rows = rows.groupBy("key").agg(F.first("is_anchor").alias("is_anchor"), F.min("row").alias("row"))
    rows = stored(rows.select("key", "is_anchor", "row.label", "row.vector"), "vectors")
    total = rows.agg(F.sum(F.size("vector").cast("bigint"))).first()[0] or 0
    fewest = min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_NUMBERS))
    shards = max(1, fewest, -(-total // SHARD_NUMBERS))
    ranged = rows.select("key", "label", "vector").repartitionByRange(
        shards, F.size("vector"), "label", F.get("vector", F.lit(0)), "key"
    )
    schema = "shard int, place bigint, key bigint, label bigint, vector array<int>"
    index = stored(ranged.mapInArrow(_packed, schema), "packed")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    anchors = rows.where("is_anchor").select("key", "label", "vector")

    def first_positives(search, _ids, _scores):
        return [(search.key, found, score) for score, found in search.best(positives, same=True)]

    names = ["anchor_id", "positive_id", "positive_score"]
    found = _best(_visited(index, anchors, shards, first_positives, names), names[:1], *reversed(names[1:]), positives)
    found = stored(found.drop("rank"), "positives")
    lists = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))
    windows = anchors.join(lists, F.col("key") == F.col("anchor_id")).select(
        "key", "label", "vector", F.col("found.positive_id").alias("positives"), F.col("found.positive_score").alias("scores")
    )

    def within_windows(search, ids, scores):
        out = []
        for positive, score in zip(ids, scores, strict=True):
            least, most = -(-low * score // 100), high * score // 100
            if least <= most:
                for value, negative in search.best(negatives, same=False, low=least, high=most):
                    out.append((search.key, positive, negative, score, value))
        return out

    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    mined = _visited(index, windows, shards, within_windows, names)
    mined = _best(mined, names[:2], "negative_score", "negative_id", negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), *names[2:])


def relabelled(vectors: DataFrame) -> DataFrame:
    """The registered query's labels: those of ids divisible by 7 are moved on by one, modulo 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))


def oracle_sql() -> str:
    return """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
               list_inner_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT p.anchor_id, positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
     AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
    """
