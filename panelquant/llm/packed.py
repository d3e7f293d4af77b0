"""Shuffles of many small records as few rows: a row holds the records of one bucket, packed.

A task deals its records to buckets and sends each bucket's as one binary value; the
receiving task gets its buckets one after another, in order. The number of buckets
follows the number of records, so what a task holds at once doesn't grow with the
table; the number of partitions is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket bigint, kind int, records binary"


def buckets(records: int, each: int = 50_000) -> int:
    """A number of buckets of about ``each`` records."""
    return max(16, records // each)


def deal(key: np.ndarray, n: int) -> np.ndarray:
    """The bucket below ``n`` of each 64-bit key."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def rows(bucket: np.ndarray, records: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """A row for each bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    offsets = np.append(starts, len(bucket)).astype(np.int32) * np.int32(records.dtype.itemsize)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
    return pa.record_batch(
        [pa.array(bucket[starts]), pa.array(np.full(len(starts), kind, np.int32)), packed], ["bucket", "kind", "records"]
    )


def unpack(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """All records of a column of packed ones."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype)


def exchanged(df: DataFrame) -> DataFrame:
    """Rows of :data:`SCHEMA`, each bucket's together and in one task."""
    return df.repartition("bucket").sortWithinPartitions("bucket", "kind")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, pa.Array]]]]:
    """(bucket, its (kind, column of packed records) in pieces) of sorted rows; take all pieces before the next bucket."""
    pieces = _pieces(batches)
    ahead = next(pieces, None)

    def own(bucket: int) -> Iterator[tuple[int, pa.Array]]:
        nonlocal ahead
        while ahead is not None and ahead[0] == bucket:
            yield ahead[1:]
            ahead = next(pieces, None)

    while ahead is not None:
        bucket = ahead[0]
        yield bucket, own(bucket)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    for batch in batches:
        bucket, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
        if not len(bucket):
            continue
        cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
            yield int(bucket[a]), int(kind[a]), batch.column("records").slice(a, b - a)


def meetings(
    chunks: Iterator[np.ndarray], few: int, of_few: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 20
) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(x, p, star): the pairs of nodes to compare among those that share a key; records have key, order, node.

    A group of more than ``few`` members gets a pivot, its first by (order, node) so far, and its
    members are paired with that alone (``star``). ``of_few(records, group)`` gives the pairs of
    the other groups. After ``limit`` records the large groups' members are let go, and later ones
    are paired with the pivot as they come, so a group of any size takes bounded memory.
    """
    kept, keys, pivots = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settled(records: np.ndarray, final: bool):
        nonlocal kept, keys, pivots
        if len(keys):
            at = np.minimum(np.searchsorted(keys, records["key"]), len(keys) - 1)
            known = keys[at] == records["key"]
            own = records["node"][known]
            yield own, pivots[at[known]], True
            records = records[~known]
        records = records[np.lexsort((records["node"], records["order"], records["key"]))]
        first = np.ones(len(records), bool)
        first[1:] = records["key"][1:] != records["key"][:-1]
        group = np.cumsum(first) - 1
        start, size = np.flatnonzero(first), np.bincount(group, minlength=0)
        large = size > few
        in_large = large[group] if len(group) else np.zeros(0, bool)
        pivot = records["node"][start]
        yield records["node"][in_large], pivot[group[in_large]], True
        if final:
            rest = ~in_large
            if rest.any():
                x, p = of_few(records[rest], group[rest])
                yield x, p, False
            return
        order = np.argsort(np.concatenate([keys, records["key"][start[large]]]), kind="stable")
        keys, pivots = np.concatenate([keys, records["key"][start[large]]])[order], np.concatenate([pivots, pivot[large]])[order]
        kept = records[~in_large]

    for chunk in chunks:
        kept = chunk if kept is None else np.concatenate([kept, chunk])
        if len(kept) > limit:
            yield from settled(kept, False)
    if kept is not None:
        yield from settled(kept, True)


def no_pairs(records: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For :func:`meetings`, where every group of two or more has a pivot."""
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def all_pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs i < j inside each run of equal ``group``."""
    n = len(group)
    first = np.ones(n, bool)
    first[1:] = group[1:] != group[:-1]
    end = np.append(np.flatnonzero(first)[1:], n)[np.cumsum(first) - 1]
    count = end - np.arange(n) - 1
    i = np.repeat(np.arange(n), count)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
