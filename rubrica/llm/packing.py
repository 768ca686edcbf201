"""Best-fit packing of tokenised documents into sequences, improved by swaps between bins.

Pieces of one length are interchangeable, so a packing is decided on the counts per length: at most ``capacity``
numbers, whatever the size of the corpus.  A plan is a list of bin kinds with multiplicities.  Best fit
in decreasing order builds it; a local search then moves or exchanges pieces between underfull kinds (move,
one for one, two for one) wherever the sum of squared fills grows, until a bin runs empty, and ends at the
lower bound or when nothing improves.  Pieces find their place by their rank within their length.

Results for odd input: null and empty texts are documents of the end token alone; repeated documents are
packed once per row; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.scratch import stored
from rubrica.llm.tokens import encoder, vocabulary_files

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked together.
RANKED_ROWS = 1000

Kinds = Counter  # of bins, by their lengths in decreasing order


def best_fit(counts: dict[int, int], capacity: int) -> Kinds:
    """Best fit in decreasing order of length, whole groups of equal bins at a time."""
    open_bins: dict[int, Kinds] = {}
    rooms: list[int] = []

    def put(room: int, kind: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            insort(rooms, room)
        open_bins[room][kind] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(left, capacity // size)
                bins = left // each
                put(capacity - each * size, (size,) * each, bins)
                left -= bins * each
                continue
            room = rooms[at]
            kind, n = next(iter(open_bins[room].items()))
            used = min(n, left)
            open_bins[room][kind] -= used
            if not open_bins[room][kind]:
                del open_bins[room][kind]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            put(room - size, (*kind, size), used)
            left -= used
    kinds: Kinds = Counter()
    for group in open_bins.values():
        for kind, n in group.items():
            kinds[tuple(sorted(kind, reverse=True))] += n
    return kinds


def _exchange(giver: tuple[int, ...], taker: tuple[int, ...], capacity: int):
    """The (given, returned) pieces that move most length into the fuller bin, or None.

    Moving length from a bin to one that is at least as full always raises the sum of squared fills.
    """
    room = capacity - sum(taker)
    have = Counter(giver)
    singles = sorted(have, reverse=True)
    best, choice = 0, None
    for a in singles:
        if best < a <= room:
            best, choice = a, ((a,), ())
    back = sorted(set(taker))
    offers = [(a,) for a in singles]
    offers += [(a, b) for i, a in enumerate(singles) for b in singles[i:] if a != b or have[a] > 1]
    for offer in offers:
        total = sum(offer)
        at = bisect_left(back, total - room)
        if at < len(back) and best < total - back[at]:
            best, choice = total - back[at], (offer, (back[at],))
    return choice


def _without(kind: tuple[int, ...], gone: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, ...]:
    rest = list(kind)
    for size in gone:
        rest.remove(size)
    return tuple(sorted([*rest, *new], reverse=True))


def improve(kinds: Kinds, capacity: int) -> Kinds:
    """Local search: exchange pieces between underfull bins until no exchange raises the squared fill.

    It stops early at the least possible number of bins.
    """
    kinds = Counter(kinds)
    total = sum(sum(kind) * n for kind, n in kinds.items())
    least = -(-total // capacity)
    settled: set[tuple[tuple[int, ...], tuple[int, ...]]] = set()
    moved = True
    while moved and sum(kinds.values()) > least:
        moved = False
        underfull = sorted((k for k in kinds if sum(k) < capacity), key=lambda k: (sum(k), k))
        for i, giver in enumerate(underfull):
            for taker in reversed(underfull[i:]):
                if giver == taker and kinds[giver] < 2 or (giver, taker) in settled:
                    continue
                choice = _exchange(giver, taker, capacity)
                if choice is None:
                    settled.add((giver, taker))
                    continue
                n = kinds[giver] // 2 if giver == taker else min(kinds[giver], kinds[taker])
                for kind, out, new in ((giver, *choice), (taker, choice[1], choice[0])):
                    kinds[kind] -= n
                    after = _without(kind, out, new)
                    if after:
                        kinds[after] += n
                kinds += Counter()
                moved = True
                break
            if moved:
                break
    return kinds


def places(kinds: Kinds) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), by length and rank."""
    rows, used, base = [], Counter(), 0
    for kind, n in sorted(kinds.items(), reverse=True):
        offset = 0
        for size in kind:
            rows.append((size, used[size], used[size] + n, base, offset))
            used[size] += n
            offset += size
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, key: str, text: str, capacity: int, files: tuple[str, str], with_ids: bool) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def pieces(batches):
        coder = encoder(files)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column("text")):
                tokens = np.append(coder.ids(value.as_py()), np.uint32(END_ID)).astype("<u4", copy=False)
                n = len(tokens)
                first = n - (-(-n // capacity) - 1) * capacity
                ends = list(range(first, n + 1, capacity))
                for k, (s, e) in enumerate(zip([0, *ends], ends, strict=False)):
                    raw = tokens[s:e].tobytes()
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw))
                    if with_ids:
                        ids.append(raw)
            columns = [
                batch.column("key").take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(texts.dtypes)["key"]
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return texts.mapInArrow(pieces, schema)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    files: tuple[str, str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence and offset; ``ids`` (little-endian unsigned 32-bit) on request."""
    spark = docs.sparkSession
    pieces = stored(cut(docs, key, text, capacity, files or vocabulary_files(), with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = spark.createDataFrame(
        [(length, -(-n // RANKED_ROWS)) for length, n in counts.items()], "length bigint, buckets bigint"
    )
    bucket = F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.col("buckets"))
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", bucket).drop("buckets")
    per_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    table = places(improve(best_fit(counts, capacity), capacity))
    shared = spark.sparkContext.broadcast(table)

    before = per_bucket.withColumn(
        "before",
        F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"),
    ).drop("n")
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece", "ids_crc32"))
    ranked = (
        pieces.withColumn("nth", nth - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", (F.col("nth") + F.col("before")).cast("bigint"))
        .drop("bucket", "nth", "before")
    )

    def assign(batches):
        rows = shared.value
        codes = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(codes, length.astype(np.int64) << 44 | rank, "right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(rows[at, 4])],
                names=[*keep, "sequence_id", "offset"],
            )

    plain = ranked.select("key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")
    kind = dict(plain.dtypes)["key"]
    schema = (
        f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
        + ", ids binary" * with_ids
        + ", sequence_id bigint, offset bigint"
    )
    return plain.mapInArrow(assign, schema).withColumnRenamed("key", key)
