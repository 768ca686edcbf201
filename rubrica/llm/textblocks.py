"""Texts as byte blocks: vectorised words, hashes and digests inside Arrow tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; the arrays made from them take some sixty times as much.
BLOCK_BYTES = (1 << 20) - 64
#: An odd multiplier and its inverse modulo 2**64, for hashes of any byte range from running sums.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for first, last in excluded:
        table[first : last + 1] = False
    return table


#: Words of everything but white space, and of letters and digits (bytes over 0x7F count as letters).
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Consecutive rows of a string column as (first row, end row, bytes, bounds); null is empty.

    A block has ``limit`` bytes at most, or one row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, count=column.offset + rows + 1)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any bits of them can serve as a hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below ``size`` at least."""
    return _powers(1 << max(20, (int(size) - 1).bit_length()))


def range_sums(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, times a power, identify byte ranges."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """Start and end of every word, and the first word of each row (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = table[data]
    change = inside[1:] != inside[:-1]
    starts = change & inside[1:]
    ends = change & inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    starts[cuts] = True
    ends[cuts] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, bounds)


def join_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + count]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(size))
