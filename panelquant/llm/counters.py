"""How often hashed elements occur in the whole corpus, in a table of counters of fixed size.

Each task counts in its own table and sends the counters that it touched, by
blocks; the merged table has one byte a counter and can be broadcast. Elements may
share a counter, so counts are upper estimates: use them to order work, not to decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: log2 of the number of counters, and of those that travel together.
COUNTER_BITS, BLOCK_BITS = 22, 16


def place(element: np.ndarray) -> np.ndarray:
    """The counter of each 64-bit hash."""
    return (element >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


class Counts:
    """A task's counters."""

    def __init__(self):
        self.counts = np.zeros(1 << COUNTER_BITS, np.uint32)

    def add(self, elements: np.ndarray) -> None:
        np.add.at(self.counts, place(elements), 1)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(block, cells) of the touched counters."""
        touched = np.flatnonzero(self.counts)
        for b in np.unique(touched >> BLOCK_BITS).tolist():
            own = touched[slice(*np.searchsorted(touched, [b << BLOCK_BITS, (b + 1) << BLOCK_BITS]))]
            cells = (own & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes()
            yield b, cells + np.minimum(self.counts[own], 65535).astype("<u2").tobytes()


def merged(blocks: DataFrame) -> np.ndarray:
    """8 * log2(1 + count), below 255, of each counter, from rows (block, cells) of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: int, total: np.ndarray) -> pa.RecordBatch:
            level = np.minimum(8 * np.log2(1 + total), 254).astype(np.uint8)
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["block", "cells"])

        block, total = None, None
        for batch in batches:
            for b, cells in zip(batch.column("block").to_pylist(), batch.column("cells")):
                if b != block:
                    if block is not None:
                        yield done(block, total)
                    block, total = b, np.zeros(1 << BLOCK_BITS)
                where, count = np.frombuffer(cells.as_buffer(), "<u2").reshape(2, -1)
                total[where] += count
        if block is not None:
            yield done(block, total)

    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    sorted_blocks = blocks.select("block", "cells").repartition("block").sortWithinPartitions("block")
    for row in sorted_blocks.mapInArrow(run, "block bigint, cells binary").collect():  # one job; the table's size is fixed
        start = row["block"] << BLOCK_BITS
        out[start : start + (1 << BLOCK_BITS)] = np.frombuffer(bytes(row["cells"]), np.uint8)
    return out
