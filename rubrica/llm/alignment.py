"""Alignment of two tokenizers' tokens: groups between common ends, links of overlapping tokens, corpus-wide link counts.

A text with a space before it is encoded by a byte-level vocabulary (A) and, by a piece vocabulary that adds this space itself
(B).  Both cover the same bytes; offsets where tokens of both end cut them into groups, and every stretch between two
neighbouring ends of either lies in one token of each: a link.

Very long texts are cut into ranges of ``CHUNK`` characters.  In each range A's tokens begin at the first place where A's
pattern always starts anew, B's at the first where no piece of B can reach across, so a range ends at different
places for A and B and leaves tokens open.  A range gives a fragment: an open prefix (tokens up to the first common
end), closed groups, an open suffix (tokens after the last one).  ``compose`` joins neighbouring fragments; it is
associative, so a tree of Spark tasks, ``FAN`` fragments each, reduces a document, whatever its length.  Closed groups
leave the tree as rows of their own; only open ends travel upwards.  The digest of a long document's groups is taken
by one task that streams its closed groups in order.

A pair's count is the number of documents that hold it linked.  Documents keep each distinct pair with its
multiplicity; counts are combined within tasks and come back by a join that broadcasts them only after summing their bytes, and
spreads hot pairs over sub-keys beyond.

Results for odd input: texts that are null or empty, or that a vocabulary does not give back byte by byte, have zeros
and an empty digest and count for no pair; every row is a document of its own, repeated ids included; null ids are kept; a text
without white space is one range for B; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.scratch import dropped, stored
from rubrica.operators.lookup import lookup_join

#: Characters of a range; longer texts are cut.
CHUNK = 1 << 15
#: Fragments that one step of the tree composes.
FAN = 8
#: Bytes of text aligned at a time.
BLOCK = 1 << 20
#: A pair is one number: A's id, then B's id in so many bits.
B_BITS = 21

WHOLE, FRAGMENT, CLOSED = 0, 1, 2
#: A's pattern starts a new piece at white space after anything else, B's pieces hold their space mark in front only.
A_STARTS, B_STARTS = re.compile(r"(?<=\S)[ \t\n\r]"), re.compile(r"(?<=\S) ")
#: Texts whose characters every version of the pattern's classes sorts alike.
PLAIN = re.compile(r"[\n\t\x20-\x7e¡-¬®-ɏ]*")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Coders:
    """Both vocabularies: ids of texts and bytes of ids.

    A's entries are read from the tokenizer file; plain texts are encoded by the faster library from these entries,
    whose ids are their merge order, the rest by the tokenizer file's own library.
    """

    def __init__(self, a_file: str, b_file: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_file)
        self.slow.encode_special_tokens = True
        with open(a_file, encoding="utf-8") as file:
            entries = json.load(file)
        letters = _byte_letters()
        special = {x["id"] for x in entries["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in entries["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max([*ranks.values(), *special]) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b = SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space inside: texts cannot be cut at spaces")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            for p in pieces
        ]
        self.a_widths = np.array([len(x) for x in self.a_bytes])
        self.b_widths = np.array([len(x) for x in self.b_bytes])
        most = max(len(pieces), len(self.a_bytes))
        self.shown = np.array([f"{i}{end}" for end in ",|;" for i in range(most)], dtype=object)
        self.ends = most

    def a_ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def b_ids(self, text: str) -> np.ndarray:
        """``text`` begins with the space that B adds."""
        return np.array(self.b.encode(text[1:], num_threads=1), np.int64)

    def covers(self, ids: np.ndarray, table: list[bytes], raw: bytes) -> bool:
        return b"".join([table[i] for i in ids.tolist()]) == raw


_CODERS: dict[tuple[str, str], Coders] = {}


def coders(files: tuple[str, str]) -> Coders:
    """One pair per Python worker."""
    if files not in _CODERS:
        _CODERS[files] = Coders(*files)
    return _CODERS[files]


@dataclass
class Stream:
    """Tokens of A and of B with their ends in bytes."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def common(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def until(self, end: int) -> tuple[Stream, Stream]:
        """Tokens that end at ``end`` or before, and the others."""
        i, j = np.searchsorted(self.a_ends, end, "right"), np.searchsorted(self.b_ends, end, "right")
        return (
            Stream(self.a[:i], self.a_ends[:i], self.b[:j], self.b_ends[:j]),
            Stream(self.a[i:], self.a_ends[i:], self.b[j:], self.b_ends[j:]),
        )

    def __add__(self, other: Stream) -> Stream:
        pairs = zip(self.columns(), other.columns(), strict=True)
        return Stream(*(np.concatenate(x) for x in pairs))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends


def nothing() -> Stream:
    return Stream(*(np.zeros(0, np.int64) for _ in range(4)))


@dataclass
class Fragment:
    """``head`` up to the first common end (all tokens if there is none), ``tail`` after the last."""

    head: Stream
    tail: Stream
    cut: bool


def fragment(stream: Stream) -> tuple[Fragment, Stream]:
    """The open ends of a stream, and the closed groups between them."""
    common = stream.common()
    if not len(common):
        return Fragment(stream, nothing(), False), nothing()
    head, rest = stream.until(common[0])
    closed, tail = rest.until(common[-1])
    return Fragment(head, tail, True), closed


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, Stream]:
    """Two neighbouring fragments as one, and the groups that closes."""
    middle, closed = fragment((x.tail if x.cut else x.head) + y.head)
    tail = y.tail if y.cut else middle.tail
    if not x.cut:
        return Fragment(middle.head, tail, middle.cut), closed
    if not middle.cut:
        return Fragment(x.head, middle.head, True), nothing()
    return Fragment(x.head, tail, True), middle.head + closed


@dataclass
class Aligned:
    """Groups and links of tokens that begin and end at common ends, by row."""

    n_groups: np.ndarray
    n_links: np.ndarray
    texts: list[str]
    codes: list[np.ndarray]
    times: list[np.ndarray]


def aligned(stream: Stream, row_ends: np.ndarray, coder: Coders) -> Aligned:
    """``row_ends``: the byte offset at which each row ends, itself a common end unless the row is empty."""
    rows = len(row_ends)
    a, a_ends, b, b_ends = stream.columns()
    common = stream.common()
    ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
    ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
    code = (a[np.searchsorted(a_ends, ends)] << B_BITS) | b[np.searchsorted(b_ends, ends)]
    link_row, group_row = np.searchsorted(row_ends, ends), np.searchsorted(row_ends, common)
    distinct, times = np.unique((link_row << 43) | code, return_counts=True)
    bounds = np.searchsorted(distinct >> 43, np.arange(rows + 1))
    distinct &= (1 << 43) - 1

    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    a_count, b_count = (np.bincount(g, minlength=len(common)) for g in (a_group, b_group))
    shown = np.zeros(len(a) + len(b), np.int64)
    a_last, b_last = np.cumsum(a_count), np.cumsum(b_count)
    a_end = np.zeros(len(a), np.int64)
    b_end = np.zeros(len(b), np.int64)
    if len(common):
        a_end[a_last - 1] = coder.ends
        b_end[b_last - 1] = 2 * coder.ends
    shown[np.arange(len(a)) + (b_last - b_count)[a_group]] = a + a_end
    shown[np.arange(len(b)) + a_last[b_group]] = b + b_end
    words = coder.shown[shown]
    per_row = np.cumsum(np.bincount(group_row, weights=a_count + b_count, minlength=rows).astype(np.int64))
    starts = np.concatenate(([0], per_row))
    texts = ["".join(words[starts[r] : starts[r + 1]].tolist())[:-1] for r in range(rows)]
    cut = [slice(bounds[r], bounds[r + 1]) for r in range(rows)]
    return Aligned(
        np.bincount(group_row, minlength=rows),
        np.bincount(link_row, minlength=rows),
        texts,
        [distinct[c] for c in cut],
        [times[c] for c in cut],
    )


_STREAMS = [f"{part}_{name}" for part in ("head", "tail") for name in ("a", "a_ends", "b", "b_ends")]
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_ARRAYS = [*_STREAMS, "codes", "times"]


def _schema(key_type: str) -> str:
    return (
        f"kind int, row bigint, doc_id {key_type}, at bigint, ok boolean, cut boolean, groups string, "
        + ", ".join(f"{c} bigint" for c in _NUMBERS)
        + ", "
        + ", ".join(f"{c} array<bigint>" for c in _ARRAYS)
    )


class _Rows:
    """Result rows gathered column by column."""

    def __init__(self, key_type: pa.DataType):
        self.key_type, self.columns, self.size = key_type, {}, 0

    def add(self, kind, row, key, at, ok=True, numbers=(0, 0, 0, 0), groups="", codes=None, times=None, open_ends=None):
        values = {"kind": kind, "row": row, "doc_id": key, "at": at, "ok": ok, "groups": groups}
        values["cut"] = bool(open_ends and open_ends.cut)
        values |= dict(zip(_NUMBERS, (int(n) for n in numbers), strict=True)) | {"codes": codes, "times": times}
        arrays = (*open_ends.head.columns(), *open_ends.tail.columns()) if open_ends else [None] * 8
        values |= dict(zip(_STREAMS, arrays, strict=True))
        for name, value in values.items():
            self.columns.setdefault(name, []).append(value)
        self.size += len(groups) + sum(8 * len(values[c]) for c in _ARRAYS if values[c] is not None)

    def batch(self) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "row": pa.int64(), "doc_id": self.key_type, "at": pa.int64(), "ok": pa.bool_()}
        kinds |= {"cut": pa.bool_(), "groups": pa.string()} | dict.fromkeys(_NUMBERS, pa.int64())
        kinds |= dict.fromkeys(_ARRAYS, pa.list_(pa.int64()))
        arrays = [pa.array(self.columns[c], kind) for c, kind in kinds.items()]
        self.columns, self.size = {}, 0
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _ranges(text: str, size: int):
    """Ranges of a text as (text, places in it where A's and B's tokens begin and end, their first bytes in the whole)."""
    whole = " " + text
    a = b = a_at = b_at = 0
    target = 0
    while a < len(whole) or b < len(whole):
        target += size
        stops = []
        for at, starts in ((a, A_STARTS), (b, B_STARTS)):
            found = starts.search(whole, max(target, at)) if max(target, at) < len(whole) - 1 else None
            stops.append(found.start() if found and found.start() < len(whole) - 1 else len(whole))
        first, last = min(a, b), max(stops)
        if (a, b) != tuple(stops):
            yield whole[first:last], a - first, stops[0] - first, b - first, stops[1] - first, a_at, b_at
        a_at += len(whole[a : stops[0]].encode())
        b_at += len(whole[b : stops[1]].encode())
        a, b = stops


def _cutting(size: int, key_type: pa.DataType):
    """A task function: long texts to rows of ranges."""

    def cut(batches):
        names = ["row", "doc_id", "chunk", "text", "a_from", "a_to", "b_from", "b_to", "a_at", "b_at"]
        kinds = [pa.int64(), key_type, pa.int64(), pa.string(), *[pa.int64()] * 6]
        for batch in batches:
            for row, key, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                rows = []
                for chunk, part in enumerate(_ranges(text, size)):
                    rows.append((row, key, chunk, *part))
                    if len(rows) == 64:
                        yield _table(rows, kinds, names)
                        rows = []
                if rows:
                    yield _table(rows, kinds, names)

    return cut


def _table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _whole_texts(files: tuple[str, str], key_type: pa.DataType):
    """A task function: texts of one range each, encoded and aligned in blocks."""

    def align(batches):
        coder = coders(files)
        for batch in batches:
            out = _Rows(key_type)
            rows, keys, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            start = 0
            while start < len(rows):
                end, size = start, 0
                parts, row_ends = [], []
                while end < len(rows) and size < BLOCK:
                    whole = " " + texts[end]
                    raw = whole.encode()
                    a = b = np.zeros(0, np.int64)
                    if texts[end]:
                        a, b = coder.a_ids(whole), coder.b_ids(whole)
                        if not (coder.covers(a, coder.a_bytes, raw) and coder.covers(b, coder.b_bytes, raw)):
                            a = b = np.zeros(0, np.int64)
                    parts.append(Stream(a, size + np.cumsum(coder.a_widths[a]), b, size + np.cumsum(coder.b_widths[b])))
                    size += len(raw)
                    row_ends.append(size)
                    end += 1
                stream = Stream(*(np.concatenate(x) for x in zip(*(p.columns() for p in parts), strict=True)))
                found = aligned(stream, np.array(row_ends), coder)
                for i, part in enumerate(parts):
                    numbers = (len(part.a), len(part.b), found.n_groups[i], found.n_links[i])
                    digest = hashlib.sha256(found.texts[i].encode()).hexdigest() if len(part.a) else ""
                    place = start + i
                    out.add(WHOLE, rows[place], keys[place], 0, len(part.a) > 0, numbers, digest, found.codes[i], found.times[i])
                if out.size > 4 * BLOCK:
                    yield out.batch()
                start = end
            if out.columns:
                yield out.batch()

    return align


def _close(out: _Rows, row, key, stream: Stream, start: int, coder: Coders) -> None:
    """A row of closed groups; ``start`` is the offset at which they begin."""
    if len(stream.a):
        found = aligned(stream, stream.a_ends[-1:], coder)
        numbers = (0, 0, found.n_groups[0], found.n_links[0])
        out.add(CLOSED, row, key, start, True, numbers, found.texts[0], found.codes[0], found.times[0])


def _range_fragments(files: tuple[str, str], key_type: pa.DataType):
    """A task function: ranges of long texts to fragments and closed groups."""

    def align(batches):
        coder = coders(files)
        for batch in batches:
            out = _Rows(key_type)
            for x in batch.to_pylist():
                text_a, text_b = x["text"][x["a_from"] : x["a_to"]], x["text"][x["b_from"] : x["b_to"]]
                a = coder.a_ids(text_a) if text_a else np.zeros(0, np.int64)
                b = coder.b_ids(text_b) if text_b else np.zeros(0, np.int64)
                ok = coder.covers(a, coder.a_bytes, text_a.encode()) and coder.covers(b, coder.b_bytes, text_b.encode())
                if not ok:
                    a = b = np.zeros(0, np.int64)
                stream = Stream(a, x["a_at"] + np.cumsum(coder.a_widths[a]), b, x["b_at"] + np.cumsum(coder.b_widths[b]))
                open_ends, closed = fragment(stream)
                out.add(FRAGMENT, x["row"], x["doc_id"], x["chunk"], ok, (len(a), len(b), 0, 0), open_ends=open_ends)
                if open_ends.cut:
                    _close(out, x["row"], x["doc_id"], closed, open_ends.head.a_ends[-1], coder)
                if out.size > 4 * BLOCK:
                    yield out.batch()
            if out.columns:
                yield out.batch()

    return align


def _composing(files: tuple[str, str], key_type: pa.DataType, last: bool):
    """A task function: runs of neighbouring fragments to one each; ``last`` closes the head of a whole document."""

    def reduce(batches):
        coder = coders(files)
        out = _Rows(key_type)
        state = None

        def done():
            row, at, key, ok, n_a, n_b, total = state
            if last and total.cut:
                _close(out, row, key, total.head, 0, coder)
            out.add(FRAGMENT, row, key, at, ok, (n_a, n_b, 0, 0), open_ends=total)

        for batch in batches:
            for x in batch.to_pylist():
                one = Fragment(
                    Stream(*(np.array(x[c], np.int64) for c in _STREAMS[:4])),
                    Stream(*(np.array(x[c], np.int64) for c in _STREAMS[4:])),
                    x["cut"],
                )
                if state is None or (x["row"], x["group"]) != state[:2]:
                    if state:
                        done()
                    state = (x["row"], x["group"], x["doc_id"], x["ok"], x["n_a"], x["n_b"], one)
                else:
                    total, closed = compose(state[-1], one)
                    if len(closed.a):
                        lengths = coder.a_widths[closed.a[:1]]
                        _close(out, x["row"], x["doc_id"], closed, int(closed.a_ends[0] - lengths[0]), coder)
                    state = (*state[:3], state[3] and x["ok"], state[4] + x["n_a"], state[5] + x["n_b"], total)
                if out.size > 4 * BLOCK:
                    yield out.batch()
        if state:
            done()
        if out.columns:
            yield out.batch()

    return reduce


def _digests(batches):
    """Closed groups of long documents in order: digest and sums of each document."""
    state, out = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("row", "groups", "n_groups", "n_links"))
        for row, groups, n_groups, n_links in zip(*columns, strict=True):
            if state is None or state[0] != row:
                if state:
                    out.append((state[0], state[1].hexdigest(), *state[2:]))
                state = (row, hashlib.sha256(groups.encode()), n_groups, n_links)
            else:
                state[1].update(b";" + groups.encode())
                state = (*state[:2], state[2] + n_groups, state[3] + n_links)
        if out:
            yield _table(out, [pa.int64(), pa.string(), pa.int64(), pa.int64()], ["row", "groups", "n_groups", "n_links"])
            out = []
    if state:
        out = [(state[0], state[1].hexdigest(), *state[2:])]
        yield _table(out, [pa.int64(), pa.string(), pa.int64(), pa.int64()], ["row", "groups", "n_groups", "n_links"])


def _long_documents(texts: DataFrame, files, size: int, schema: str, key_type: pa.DataType) -> tuple[DataFrame, DataFrame]:
    """Summary rows of long documents, and their (row, code, times)."""
    spark = texts.sparkSession
    kind = dict(texts.dtypes)["doc_id"]
    pieces = (
        f"row bigint, doc_id {kind}, chunk bigint, text string, a_from bigint, a_to bigint, b_from bigint, b_to bigint, "
        "a_at bigint, b_at bigint"
    )
    ranges = stored(texts.mapInArrow(_cutting(size, key_type), pieces), "ranges")
    spread = ranges.repartition("row", "chunk")
    level = stored(spread.mapInArrow(_range_fragments(files, key_type), schema), "fragments")
    dropped(spark, ranges)
    closed = [level.where(F.col("kind") == CLOSED)]
    count = (level.where(F.col("kind") == FRAGMENT).agg(F.max("at")).first()[0] or 0) + 1
    while True:
        count = -(-count // FAN)
        group = F.floor(F.col("at") / FAN).alias("group")
        runs = level.where(F.col("kind") == FRAGMENT).select("*", group).repartition("row", "group")
        runs = runs.sortWithinPartitions("row", "group", "at")
        level = stored(runs.mapInArrow(_composing(files, key_type, count == 1), schema), "composed")
        closed.append(level.where(F.col("kind") == CLOSED))
        if count == 1:
            break
    roots = level.where(F.col("kind") == FRAGMENT).select("row", "doc_id", "ok", "n_a", "n_b")
    groups = closed[0]
    for more in closed[1:]:
        groups = groups.unionByName(more)
    groups = groups.join(roots.where("ok").select("row"), "row", "left_semi")
    in_order = groups.select("row", "at", "groups", "n_groups", "n_links").repartition("row").sortWithinPartitions("row", "at")
    digests = in_order.mapInArrow(_digests, "row bigint, groups string, n_groups bigint, n_links bigint")
    zero = F.lit(0).cast("bigint")
    summary = roots.join(digests, "row", "left").select(
        "row",
        "doc_id",
        *(F.when(F.col("ok"), F.col(c)).otherwise(zero).alias(c) for c in ("n_a", "n_b")),
        *(F.coalesce(c, zero).alias(c) for c in ("n_groups", "n_links")),
        F.coalesce("groups", F.lit("")).alias("groups"),
    )
    links = groups.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x"))
    links = links.groupBy("row", F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("times"))
    return stored(summary, "long-summary"), stored(links, "long-links")


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", files: tuple[str, str] | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    from pyspark.sql.pandas.types import to_arrow_type

    files = files or default_files()
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    key_type = to_arrow_type(texts.schema["doc_id"].dataType)
    schema = _schema(dict(texts.dtypes)["doc_id"])
    is_long = F.length("text") > chunk
    whole = stored(texts.where(~is_long).mapInArrow(_whole_texts(files, key_type), schema), "aligned")
    far = texts.where(is_long).withColumn("row", -1 - F.col("row"))
    long_ones, long_links = _long_documents(far, files, chunk, schema, key_type)

    pairs = whole.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x"))
    links = pairs.select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times")).unionByName(long_links)
    counted = stored(links.groupBy("code").agg(F.count("*").alias("n")), "pair-counts")
    first = F.shiftright("code", B_BITS).alias("a_id")
    highest = counted.groupBy(first).agg(F.max("n").alias("most"))
    counts = lookup_join(counted.select("code", "n", first), highest, ["a_id"], ["code"])
    counts = stored(counts.select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pair-ranks")
    scored = lookup_join(links, counts, ["code"], ["row"])
    sums = scored.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    every = whole.select(*columns).unionByName(long_ones.select(*columns))
    zero = F.lit(0).cast("bigint")
    return every.join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
