"""Repeated byte strings across a corpus, by enhanced suffix arrays over shards of anchored spans.

Every string of ``LENGTH`` bytes (a window) picks the smallest hash among its strings of ``GRAM`` bytes as its
anchor, so equal windows have equal anchors wherever they lie.  Consecutive windows with the same anchor
form a span, about 35 windows long.

1. Anchors are shuffled by hash; those that occur once cannot be in a repeat.  Equal spans become one span with a first
   occurrence, within a batch before the shuffle and among all after it; the others are repeats of it throughout.
2. The texts of spans whose anchor has different spans are dealt to shards by anchor.  A shard sorts the suffixes that start at
   its windows (a suffix array), takes the common prefix lengths of neighbours, and scans them with a stack:
   every interval of common prefix ``LENGTH`` or more is a node of the interval tree, with all its occurrences.
   Left extension: if all occurrences of a node follow the same byte within their spans, the node one byte to the
   left repeats as often and is longer, so this one is not maximal and is left out.
   An occurrence is reported at the deepest node where an earlier one exists.
3. Anchors with very many different spans are not sorted in one place: their windows are shuffled by hash instead.

The removed bytes of a document are the union of its reported occurrences.  Nothing is looked up by a text prefix or cut at a
length; a repeat of any length is covered by its overlapping spans.

Results for odd input: null and empty texts have no bytes; documents are ordered by id (null first), then by hash of the text; rows
that repeat id and text are one document and get the same result; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.scratch import stored
from rubrica.llm.textblocks import mix, powers, range_hashes, range_sums, text_blocks
from rubrica.operators.ordering import with_row_index

LENGTH = 100
GRAM = 32
#: Text of spans that are sorted together in a task.
SHARD_BYTES = 1 << 20
#: Different spans of an anchor from which its windows are shuffled one by one.
HOT_SPANS = 20_000


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def spans_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Spans of a block: row, start in its text, number of windows, offset of the anchor, anchor and span hash."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < length:
        return empty
    sums = range_sums(data)
    _, down = powers(n + 1)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 32) - 1)
    least = _sliding_least((grams & ~low) | places, length - gram + 1) & low
    starts = np.arange(n - length + 1)
    row = np.searchsorted(bounds, starts, "right") - 1
    valid = starts + length <= bounds[row + 1]
    starts, row, anchor = starts[valid], row[valid], least[valid].astype(np.int64)
    if not len(starts):
        return empty
    turn = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.concatenate(([0], np.flatnonzero(turn) + 1))
    count = np.diff(np.concatenate((first, [len(starts)])))
    begin, anchor = starts[first], anchor[first]
    whole = range_hashes(sums, begin, begin + count - 1 + length)
    offset = anchor - begin
    whole = mix(whole ^ offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return row[first], begin - bounds[row[first]], count, offset, grams[anchor], whole


def _later_copies(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Spans that equal an earlier one of these."""
    order = np.lexsort((place, doc))
    code = (mix(anchor) ^ whole)[order]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    first = first[group]
    same = (anchor[order] == anchor[order][first]) & (whole[order] == whole[order][first])
    later = np.zeros(len(doc), dtype=bool)
    later[order] = same & (first != np.arange(len(doc)))
    return later


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per span; ``known`` is 1 where an earlier span of the same batch is equal."""

    def find(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            parts = []
            for low, _, data, bounds in text_blocks(batch.column("text")):
                row, start, count, offset, anchor, whole = spans_of(data, bounds, length, gram)
                parts.append((docs[low + row], start << 16 | count << 8 | offset, anchor, whole))
            if not parts:
                continue
            doc, place, anchor, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            known = _later_copies(doc, place, anchor, whole)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(known.astype(np.int32)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(doc),
                    pa.array(place.astype(np.int64)),
                ],
                names=["known", "anchor", "whole", "doc", "place"],
            )

    return texts.mapInArrow(find, "known int, anchor bigint, whole bigint, doc bigint, place bigint")


def _repeated(batches):
    """Of sorted anchors: later equal spans (kind 0), and first spans of anchors with several (1; 2 if hot)."""
    rest = before = None  # ``before``: anchor, last span and number of spans of a run that goes on
    for batch in batches:
        known = batch.column("known").to_numpy() == 1
        if known.any():
            copies = batch.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(copies), np.int32)), *(copies.column(c) for c in ("anchor", "doc", "place"))],
                names=["kind", "anchor", "doc", "place"],
            )
        part = [batch.column(c).to_numpy()[~known] for c in ("anchor", "whole", "doc", "place")]
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
        if not len(part[0]):
            continue
        # The last run may go on; if it is long, its rows so far are handed on.
        last = int(np.searchsorted(part[0], part[0][-1]))
        if len(part[0]) - last > HOT_SPANS:
            out, before = _sorted_out(part, before, goes_on=True)
            yield out
            rest = None
            continue
        if last:
            out, before = _sorted_out([x[:last] for x in part], before, goes_on=False)
            yield out
        rest = [x[last:] for x in part]
    if rest is not None and len(rest[0]):
        yield _sorted_out(rest, before, goes_on=False)[0]


def _sorted_out(part, before, goes_on: bool):
    anchor, whole, doc, place = part
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_span = new_anchor | np.concatenate(([True], whole[1:] != whole[:-1]))
    run = np.cumsum(new_anchor) - 1
    joins = before is not None and before[0] == anchor[0]
    if joins and before[1] == whole[0]:
        new_span[0] = False
    spans = np.bincount(run, new_span).astype(np.int64)
    if joins:
        spans[0] += before[2]
    kind = np.where(new_span, np.where(spans[run] > HOT_SPANS, 2, 1), 0)
    several = spans > 1
    several[-1] |= goes_on
    keep = ~new_span | several[run]
    out = pa.RecordBatch.from_arrays(
        [pa.array(x[keep]) for x in (kind.astype(np.int32), anchor, doc, place)],
        names=["kind", "anchor", "doc", "place"],
    )
    return out, (anchor[-1], whole[-1], int(spans[-1])) if goes_on else None


def _span_texts(texts: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted spans."""
    wanted = firsts.groupBy(F.col("doc").alias("at")).agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))

    def extract(batches):
        for batch in batches:
            anchors, docs, places, found = [], [], [], []
            lists = batch.column("wanted")
            for doc, text, want in zip(batch.column("doc").to_pylist(), batch.column("text"), lists, strict=True):
                raw = text.as_py().encode()
                values = want.values
                anchors.append(values.field("anchor").to_numpy())
                place = values.field("place").to_numpy()
                places.append(place)
                docs.append(np.full(len(place), doc, np.int64))
                starts = place >> 16
                ends = starts + (place >> 8 & 255) - 1 + length
                found += [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(anchors)),
                        pa.array(np.concatenate(docs)),
                        pa.array(np.concatenate(places)),
                        pa.array(found, pa.binary()),
                    ],
                    names=["anchor", "doc", "place", "span"],
                )

    joined = texts.join(wanted, texts["doc"] == wanted["at"]).select("doc", "text", "wanted")
    return joined.mapInArrow(extract, "anchor bigint, doc bigint, place bigint, span binary")


def repeat_groups(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, left: np.ndarray, length: int):
    """Maximal repeats of suffixes of ``text``: (suffix, first suffix of its group, common length).

    ``starts``, ``ends``: where each suffix begins and its span ends; ``order``: rank of the occurrence;
    ``left``: the byte before it, or -1 at the start of its span.
    """
    windows = range_hashes(range_sums(text), starts, starts + length)
    by_hash = np.argsort(windows, kind="stable")
    same = windows[by_hash][1:] == windows[by_hash][:-1]
    some = np.zeros(len(starts), dtype=bool)
    some[by_hash[1:][same]] = True
    some[by_hash[:-1][same]] = True
    suffixes = np.flatnonzero(some)
    if not len(suffixes):
        return []
    sizes = ends[suffixes] - starts[suffixes]
    suffixes = suffixes[np.argsort(sizes, kind="stable")]
    sizes = ends[suffixes] - starts[suffixes]
    width = -(-int(sizes.max()) // 8) * 8
    padded = np.concatenate((text, np.zeros(width, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts[suffixes]].copy()
    rows[np.arange(width)[None, :] >= sizes[:, None]] = 0
    array = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, sizes, suffixes = rows[array], sizes[array], suffixes[array]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    return _scan(suffixes.tolist(), common.tolist(), order[suffixes].tolist(), left[suffixes].tolist(), length)


def _scan(suffixes: list[int], common: list[int], order: list[int], left: list[int], length: int):
    """Stack scan of common prefix lengths; a node holds its first occurrence, the later ones, and its left byte."""
    found = []
    stack: list[list] = []  # [common length, first, left byte or -1, later occurrences]
    common.append(0)
    for i, depth in enumerate(common):
        first, byte = i, left[i]
        while stack and stack[-1][0] > depth:
            node = stack.pop()
            first, byte = _absorbed(node, first, byte, order)
            if byte < 0:
                found += [(suffixes[k], suffixes[first], node[0]) for k in node[3]]
        if depth >= length:
            if stack and stack[-1][0] == depth:
                _absorbed(stack[-1], first, byte, order)
            else:
                stack.append([depth, first, byte, []])
    return found


def _absorbed(node: list, first: int, byte: int, order: list[int]) -> tuple[int, int]:
    if order[first] < order[node[1]]:
        node[1], first = first, node[1]
    node[3].append(first)
    if node[2] != byte:
        node[2] = -1
    return node[1], node[2]


def _shard(anchors, docs, places, spans, length: int) -> pa.RecordBatch:
    """Repeats between the spans of a shard: where the later occurrence is, its length and the first one."""
    sizes = np.array([len(s) for s in spans], np.int64)
    text = np.frombuffer(b"".join(spans), np.uint8)
    base = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    span = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
    starts = base[span] + offset
    position = (places >> 16)[span] + offset
    doc = docs[span]
    order = np.empty(len(span), np.int64)
    order[np.lexsort((position, doc))] = np.arange(len(span))
    left = np.where(offset > 0, text[starts - 1].astype(np.int64), -1)
    found = repeat_groups(text, starts, (base + sizes)[span], order, left, length)
    later, first, common = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (doc[later], position[later], common, doc[first], position[first])],
        names=["doc", "start", "length", "first_doc", "first_start"],
    )


REPEATS = "doc bigint, start bigint, length bigint, first_doc bigint, first_start bigint"


def _sharded(length: int):
    def scan(batches):
        rest = None
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ("anchor", "doc", "place")]
            part.append(np.array(batch.column("span").to_pylist() + [None], dtype=object)[:-1])
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
            edges = np.concatenate(([0], np.flatnonzero(part[0][1:] != part[0][:-1]) + 1)) if len(part[0]) else [0]
            size = np.cumsum([len(s) for s in part[3]])
            done = 0
            for edge in edges[1:]:
                if size[edge - 1] - (size[done - 1] if done else 0) >= SHARD_BYTES:
                    yield _shard(*(x[done:edge] for x in part), length)
                    done = int(edge)
            rest = [x[done:] for x in part]
        if rest is not None and len(rest[0]):
            yield _shard(*rest, length)

    return scan


def _window_rows(length: int):
    def cut(batches):
        for batch in batches:
            docs, places = batch.column("doc").to_numpy(), batch.column("place").to_numpy()
            spans = batch.column("span").to_pylist()
            if not spans:
                continue
            sizes = np.array([len(s) for s in spans], np.int64)
            sums = range_sums(np.frombuffer(b"".join(spans), np.uint8))
            count = sizes - length + 1
            span = np.repeat(np.arange(len(sizes)), count)
            offset = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
            starts = (np.cumsum(sizes) - sizes)[span] + offset
            windows = range_hashes(sums, starts, starts + length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("anchor").to_numpy()[span]),
                    pa.array(windows.view(np.int64)),
                    pa.array(docs[span]),
                    pa.array((places >> 16)[span] + offset),
                ],
                names=["anchor", "window", "doc", "start"],
            )

    return cut


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents as (doc, key, tag, text); doc is the id itself if ids are integers, unique and not null."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(value).alias("tag"), value.alias("text"))
    total = rows.agg(F.count("*"), F.count("key"), F.count_distinct("key")).first()
    if dict(rows.dtypes)["key"] in ("int", "bigint") and total[0] == total[1] == total[2]:
        return rows.withColumn("doc", F.col("key").cast("bigint"))
    numbers = with_row_index(rows.select("key", "tag").distinct(), ["key", "tag"], "doc")
    same = rows["key"].eqNullSafe(numbers["key"]) & (rows["tag"] == numbers["tag"])
    return rows.join(numbers, same).select(rows["key"], rows["tag"], rows["text"], numbers["doc"])


def _one_row_each(texts: DataFrame) -> DataFrame:
    """(doc, text) with one row per document, so that rows that repeat a document are no copies of each other."""
    total = texts.agg(F.count("*"), F.count_distinct("doc")).first()
    own = texts.select("doc", "text")
    return own if total[0] == total[1] else stored(own.dropDuplicates(["doc"]), "documents")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Later occurrences of repeated strings, of (doc, text), a row per doc: doc, start, length; first_* where a shard found it."""
    own = texts.select("doc", "text")
    anchors = _anchors(own, length, gram)
    # Copies that a batch knows of are settled: they are dealt out evenly, whatever their anchor.
    dealt = F.when(F.col("known") == 1, F.xxhash64("doc", "place")).otherwise(F.col("anchor"))
    sorted_out = stored(
        anchors.repartition(dealt)
        .sortWithinPartitions("known", "anchor", "whole", "doc", "place")
        .mapInArrow(_repeated, "kind int, anchor bigint, doc bigint, place bigint"),
        "anchors",
    )
    place = F.col("place")
    copies = sorted_out.where("kind = 0").select(
        "doc",
        F.shiftright(place, 16).alias("start"),
        (F.shiftright(place, 8).bitwiseAND(255) - 1 + length).alias("length"),
        F.lit(None).cast("bigint").alias("first_doc"),
        F.lit(None).cast("bigint").alias("first_start"),
    )
    spans = stored(_span_texts(own, sorted_out.where("kind > 0"), length), "spans")
    hot = stored(sorted_out.where("kind = 2").select("anchor").distinct(), "hot-anchors")
    cold = spans.join(hot, "anchor", "left_anti") if not hot.isEmpty() else spans
    found = (
        cold.repartition("anchor")
        .sortWithinPartitions("anchor", "doc", "place")
        .select("anchor", "doc", "place", "span")
        .mapInArrow(_sharded(length), REPEATS)
    )
    every = copies.union(found)
    if not hot.isEmpty():
        rows = spans.join(hot, "anchor", "left_semi").select("anchor", "doc", "place", "span")
        windows = stored(
            rows.mapInArrow(_window_rows(length), "anchor bigint, window bigint, doc bigint, start bigint"), "windows"
        )
        first = windows.groupBy("anchor", "window").agg(
            F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")
        )
        later = windows.join(first.where("n > 1"), ["anchor", "window"]).where(
            F.struct("doc", "start") != F.col("first")
        )
        every = every.union(
            later.select("doc", "start", F.lit(length).cast("bigint"), "first.doc", "first.start")
        )
    return stored(every, "repeats")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


def remove(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_bytes: bool = False
) -> DataFrame:
    """Per document: ``key``, n_bytes, n_removed, n_spans, kept_sha256; on request spans and the bytes kept."""
    texts = _numbered(docs, key, text)
    found = repeats(_one_row_each(texts), length)
    gathered = found.groupBy(F.col("doc").alias("at")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths")
    )
    joined = texts.join(gathered, texts["doc"] == gathered["at"], "left").select("key", "text", "starts", "lengths")
    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            columns = (batch.column(c) for c in ("text", "starts", "lengths"))
            for value, starts, lengths in zip(*columns, strict=True):
                raw = value.as_py().encode()
                spans = []
                kept = raw
                if starts.values is not None and len(starts.values):
                    s, e = starts.values.to_numpy(), lengths.values.to_numpy()
                    s, e = _merged(s, s + e)
                    spans = list(zip(s.tolist(), e.tolist(), strict=True))
                    ahead = [0, *(e for _, e in spans)]
                    kept = b"".join(raw[a:b] for a, b in zip(ahead, [*(s for s, _ in spans), len(raw)], strict=True))
                out[0].append(len(raw))
                out[1].append(len(raw) - len(kept))
                out[2].append(len(spans))
                out[3].append(hashlib.sha256(kept).hexdigest())
                if with_bytes:
                    out[4].append([{"start": s, "end": e} for s, e in spans])
                    out[5].append(kept)
            arrays = [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.string())]
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                arrays += [pa.array(out[4], interval), pa.array(out[5], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=names)

    kind = dict(joined.dtypes)["key"]
    schema = f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", spans array<struct<start:bigint,end:bigint>>, kept binary" * with_bytes
    return joined.mapInArrow(cut, schema).withColumnRenamed("key", key)
