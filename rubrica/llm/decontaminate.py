"""Benchmark decontamination: find runs of benchmark words in documents by shift tables.

Patterns are the runs of ``window`` consecutive words of each benchmark item (an item of fewer words is one
pattern).  Per pattern length a table over hashed blocks of two words says how far a window may move on
without missing a pattern, so most positions are never looked at.  Where the shift is zero, the block
at the end of the window selects a bucket of patterns, and only patterns whose words are the same, byte by
byte, count as found.  All windows of all lanes of a block of text move at once.

Results for odd input: a null or empty text has no words and no hits; an item without words matches nothing;
a null item id is reported as the empty string; equal items all count; repeated documents give one
row each; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.textblocks import (
    ALNUM,
    LOWER,
    join_hashes,
    range_hashes,
    range_sums,
    text_blocks,
    word_bounds,
)

WINDOW = 10
TABLE_BITS = 18
#: Words of a lane; long texts are scanned as several lanes that overlap by a window.
LANE = 256
#: Bytes of benchmark text in one broadcast table; a larger benchmark is scanned table by table.
TABLE_BYTES = 16 << 20


@dataclass(frozen=True)
class Patterns:
    """Patterns of one length, ordered by the block at their end."""

    length: int
    block: int
    shift: np.ndarray
    suffix: np.ndarray
    words: np.ndarray
    texts: tuple[bytes, ...]
    items: tuple[tuple[str, ...], ...]


def _words(data: np.ndarray, bounds: np.ndarray):
    data = LOWER[data]
    starts, ends, first = word_bounds(data, bounds, ALNUM)
    return data, starts, ends, first, range_hashes(range_sums(data), starts, ends)


def _slot(blocks: np.ndarray) -> np.ndarray:
    return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build_patterns(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    """Shift tables and buckets for the windows of the items, one entry per pattern length."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        data, starts, ends, _, hashes = _words(raw, np.array([0, len(raw)]))
        size = min(window, len(starts))
        if not size:
            continue
        words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        for k in range(len(words) - size + 1):
            key = b" ".join(words[k : k + size])
            found.setdefault(size, {}).setdefault(key, (hashes[k : k + size], set()))[1].add(item or "")
    tables = []
    for size, group in sorted(found.items()):
        block = min(2, size)
        words = np.array([h for h, _ in group.values()], np.uint64).reshape(-1, size)
        columns = [
            join_hashes(words[:, q : q + block].ravel(), block)[::block] for q in range(size - block + 1)
        ]
        shift = np.full(1 << TABLE_BITS, size - block + 1, np.int64)
        for q, blocks in enumerate(columns):
            np.minimum.at(shift, _slot(blocks), size - block - q)
        order = np.argsort(columns[-1], kind="stable")
        texts, owners = list(group), [tuple(sorted(s)) for _, s in group.values()]
        tables.append(
            Patterns(
                size,
                block,
                shift,
                columns[-1][order],
                words[order],
                tuple(texts[i] for i in order),
                tuple(owners[i] for i in order),
            )
        )
    return tables


def _occurrences(table: Patterns, data, starts, ends, first, hashes):
    """(first word, pattern) of every occurrence that lies within one document."""
    size, block = table.length, table.block
    blocks = join_hashes(hashes, block)
    lanes_lo, lanes_hi = [], []
    counts = np.diff(first)
    long_enough = np.flatnonzero(counts >= size)
    lanes = -(-(counts[long_enough] - size + 1) // LANE)
    row = np.repeat(long_enough, lanes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lanes_lo = first[row] + nth * LANE + size - 1
    lanes_hi = np.minimum(lanes_lo + LANE, first[row + 1])
    at, stop, candidates = lanes_lo, lanes_hi, []
    while len(at):
        step = table.shift[_slot(blocks[at - block + 1])]
        zero = step == 0
        if zero.any():
            candidates.append(at[zero])
        at = at + np.where(zero, 1, step)
        live = at < stop
        at, stop = at[live], stop[live]
    if not candidates:
        return
    end = np.sort(np.concatenate(candidates))
    tail = blocks[end - block + 1]
    low, high = np.searchsorted(table.suffix, tail, "left"), np.searchsorted(table.suffix, tail, "right")
    span = high - low
    begin = np.repeat(end - size + 1, span)
    pattern = np.repeat(low, span) + np.arange(len(begin)) - np.repeat(np.cumsum(span) - span, span)
    same = np.ones(len(begin), dtype=bool)
    for k in range(size):
        same &= hashes[begin + k] == table.words[pattern, k]
    for b, p in zip(begin[same].tolist(), pattern[same].tolist(), strict=True):
        words = (data[starts[i] : ends[i]].tobytes() for i in range(b, b + size))
        if b" ".join(words) == table.texts[p]:
            yield b, p


def _scan(tables: list[Patterns], texts: pa.Array):
    """Per row: number of words, hit word runs, their byte spans and the items found."""
    for low, high, raw, bounds in text_blocks(texts):
        data, starts, ends, first, hashes = _words(raw, bounds)
        edge = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for table in tables:
            for b, p in _occurrences(table, data, starts, ends, first, hashes):
                edge[b] += 1
                edge[b + table.length] -= 1
                row = int(np.searchsorted(first, b, "right")) - 1
                items.setdefault(row, set()).update(table.items[p])
        inside = np.cumsum(edge[:-1]) > 0
        for row in range(high - low):
            f, n = int(first[row]), int(first[row + 1])
            runs: list[dict[str, int]] = []
            if row in items:
                own = np.concatenate(([False], inside[f:n], [False]))
                turn = np.flatnonzero(own[1:] != own[:-1])
                base = int(bounds[row])
                for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                    runs.append(
                        {
                            "first_word": s,
                            "end_word": e,
                            "start": int(starts[f + s]) - base,
                            "end": int(ends[f + e - 1]) - base,
                        }
                    )
            yield n - f, runs, sorted(items.get(row, ()))


RUNS = "array<struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "start", "end")]))


def _merge(runs: list[dict[str, int]]) -> list[dict[str, int]]:
    merged: list[dict[str, int]] = []
    for run in sorted(runs, key=lambda r: r["first_word"]):
        if merged and run["first_word"] <= merged[-1]["end_word"]:
            if run["end_word"] > merged[-1]["end_word"]:
                merged[-1] = merged[-1] | {"end_word": run["end_word"], "end": run["end"]}
        else:
            merged.append(run)
    return merged


def _table_blocks(benchmark: DataFrame, item: str, text: str, window: int):
    """The benchmark in blocks of bounded size, each a list of pattern tables."""
    rows, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1] or "")
        if size > TABLE_BYTES:
            yield build_patterns(rows, window)
            rows, size = [], 0
    yield build_patterns(rows, window)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per document: ``key``, n_words, runs (hit words and byte spans, merged) and items (sorted ids).

    No shuffle: the pattern tables go to the tasks, 16 MB of benchmark text at a time; a larger
    benchmark adds further passes to the same stage.
    """
    spark = docs.sparkSession
    found = docs.select(
        F.col(key).alias("key"),
        F.col(text).cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr(f"cast(array() as {RUNS})").alias("runs"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = found.schema
    for tables in _table_blocks(benchmark, item, item_text, window):
        shared = spark.sparkContext.broadcast(tables)

        def one_pass(batches, shared=shared):
            for batch in batches:
                before = (batch.column("runs").to_pylist(), batch.column("items").to_pylist())
                n_words, runs, items = [], [], []
                scanned = _scan(shared.value, batch.column("text"))
                for (n, r, i), old_runs, old_items in zip(scanned, *before, strict=True):
                    n_words.append(n)
                    runs.append(_merge(old_runs + r) if old_runs else r)
                    items.append(sorted({*old_items, *i}) if old_items else i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        batch.column("text"),
                        pa.array(n_words, pa.int64()),
                        pa.array(runs, _ARROW_RUNS),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["key", "text", "n_words", "runs", "items"],
                )

        found = found.mapInArrow(one_pass, schema)
    return found.select(F.col("key").alias(key), "n_words", "runs", "items")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs.  No shuffle."""
    spark = docs.sparkSession
    schema = docs.schema
    for tables in _table_blocks(benchmark, item, item_text, window):
        shared = spark.sparkContext.broadcast(tables)

        def one_pass(batches, shared=shared):
            for batch in batches:
                keep = [not runs for _, runs, _ in _scan(shared.value, batch.column(text))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(one_pass, schema)
    return docs


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items per document."""
    n_hit = F.aggregate(
        "runs", F.lit(0).cast("bigint"), lambda a, r: a + r["end_word"] - r["first_word"]
    )
    return found.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    """The same report by joining every window of every document to those of the benchmark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words"
    )
    return (
        f"with docs as (select doc_id, {words} from documents), "
        f"items as (select coalesce(cast(item_id as varchar), '') as item, {words} from benchmark), "
        f"sized as (select item, words, least({window}, len(words)) as m from items where len(words) > 0), "
        "patterns as (select distinct item, m, unnest([words[i:i + m - 1] for i in range(1, len(words) - m + 2)]) as p "
        "from sized), "
        "starts as (select doc_id, words, m, unnest(range(1, len(words) - m + 2)) as i "
        "from docs join (select distinct m from patterns) sizes on len(words) >= m), "
        "windows as (select doc_id, m, i, words[i:i + m - 1] as p from starts), "
        "found as (select doc_id, w.m, i, item from windows w join patterns t on w.m = t.m and w.p = t.p), "
        "hits as (select doc_id, count(distinct k) as n_hit from "
        "(select doc_id, unnest(range(i, i + m)) as k from found) x group by doc_id), "
        "owners as (select doc_id, list_sort(list(distinct item)) as own from found group by doc_id) "
        "select d.doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(own), 0) as n_items, "
        "sha256(coalesce(array_to_string(own, ','), '')) as items_sha256, n_hit is not null as contaminated "
        "from docs d left join hits h on d.doc_id = h.doc_id left join owners o on d.doc_id = o.doc_id"
    )
