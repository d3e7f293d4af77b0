"""Vectorised text kernels: Arrow string columns in, NumPy arrays out.

The kernels work on the UTF-8 bytes of a whole Arrow batch at once, so the
cost per word is a few NumPy operations and no Python object is made for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporaries take about 60 times as much.
BLOCK_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False
NOT_ALNUM[128:] = False

NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept between calls."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        _powers[base] = table
    return table[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row starts (with one end more); null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't separators, cut at row ends.

    Returns starts, ends, and ``first``: row i has the runs first[i] to first[i + 1].
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def hash_sums(data: np.ndarray) -> np.ndarray:
    """Running sums that :func:`hashes` takes differences of; callers with several sets of spans make them once."""
    total = np.zeros(len(data) + 1, np.uint64)
    value = _BYTE_VALUE[data]
    value *= _power_table(_BASE, len(data))
    np.cumsum(value, out=total[1:])
    return total


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    total = hash_sums(data) if total is None else total
    own = (total[ends] - total[starts]) * _power_table(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(own + (ends - starts).astype(np.uint64) * _ODD)


def words(column: pa.Array, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and ``first`` as of :func:`spans`."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, separator)
    return hashes(data, starts, ends), first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from where each row's items start."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the runs of ``size`` words; of all words together where a row has fewer."""
    row = row_of(first)
    count = np.diff(first)
    hashed = np.zeros(len(word), np.uint64)
    valid = np.arange(len(word)) + size <= first[1:][row] if len(word) else np.zeros(0, bool)
    whole = len(word) - size + 1
    if whole > 0:
        acc = np.zeros(whole, np.uint64)
        for i in range(size):
            acc = acc * np.uint64(_BASE) + word[i : i + whole]
        hashed[:whole] = mix(acc + np.uint64(size))
    for r in np.flatnonzero((count > 0) & (count < size)):
        acc = 0
        for w in word[first[r] : first[r + 1]].tolist():
            acc = (acc * _BASE + w) & 0xFFFFFFFFFFFFFFFF
        hashed[first[r]] = mix(np.array([acc + int(count[r])], np.uint64))[0]
        valid[first[r]] = True
    return hashed[valid], row[valid]


def distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once per row, in any order."""
    if not len(value):
        return value, row
    key = value ^ mix(row.astype(np.uint64) * _ODD + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    order = order[keep]
    return value[order], row[order]


def sums(value: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2 ** 64 of the values of each slot."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, slot, value)
    return out


def array(values, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array; unsigned 64-bit values become signed ones with the same bits."""
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, type=kind)
