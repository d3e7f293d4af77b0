"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Bulk-synchronous best fit (:func:`pack`). The free space of open sequences is a
table of gaps. In a superstep

1. the longest pieces that no gap takes get as many empty sequences as they fill;
2. gaps are split into equal slots that take the longest piece, so that a wide gap
   can receive many pieces at once;
3. pieces and slots are range-sorted by size over the cluster, and each piece
   sweeps to its successor slot. Pieces that compete are ranked: the longer goes
   first, so a piece gets the nearest slot that no longer piece has taken. That is
   how brackets match, pieces opening and slots closing them. Each range matches its own;
   what is left over matches across ranges by its nesting level, of which a range
   has at most one opening and one closing bracket;
4. the gaps shrink by what they took, and the next superstep takes the pieces left.

Each superstep's tables are written to the shared folder. The driver sees a
histogram of at most ``capacity`` lengths and gaps, and the counts of each range.
Offsets follow at the end from the running lengths in each sequence.

Cases: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import stored

CAPACITY, END_ID = 1024, 2
#: Distinct chunks whose ids a Python worker keeps.
CACHE_CHUNKS = 600_000


class ChunkEncoder:
    """Token ids of whole texts, each distinct chunk encoded once by the tokenizer.

    Texts are cut before a single blank and around a single line break that stand
    between two characters that aren't white space, and between an ASCII letter and
    ASCII punctuation. The tokenizer's pre-tokenization always cuts there, so the
    ids of a text are the ids of its chunks, one after the other. New chunks without
    line breaks are encoded together, as lines of one text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of chunks."""
        found = self.tokenizer.encode_batch(chunks, add_special_tokens=False)
        sizes = np.fromiter((len(e) for e in found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, int(sizes.sum())), sizes

    def _encoded_lines(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks without white space but for one blank at their start, a few thousand at a time."""
        parts = []
        for a in range(0, len(chunks), 4096):
            text = "\n".join(chunks[a : a + 4096]) + "\n"
            parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        ids = np.concatenate(parts)
        breaks = np.flatnonzero(ids == self.line_break)
        return ids[ids != self.line_break], np.diff(breaks, prepend=-1) - 1

    def _add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        space = np.concatenate([[0], np.cumsum(T.BLANK[data] | (data == 0x85) | (data == 0xA0) | (data < 32) | (data == ord("<")))])
        # "<" may begin a special token; 0x85, 0xA0 and the leads of wide white space go the plain way
        wide = np.concatenate([[0], np.cumsum(_MAY_BE_SPACE[data])])
        lead = starts + (data[starts] == 32)
        plain = (space[ends] == space[lead]) & (wide[ends] == wide[starts]) & (ends > lead)
        raw = data.tobytes()
        for own, encode in ((plain, self._encoded_lines), (~plain, self._encoded)):
            if not own.any():
                continue
            flat, sizes = encode([raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist())])
            n, m = len(self.place), len(sizes)
            while n + m > len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + m] = sizes
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.place.update(zip(keys[own].tolist(), range(n, n + m)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, and how many there are up to each text's end."""
        data, offsets = T.utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            ahead, here, behind = data[2:], data[1:-1], data[:-2]
            lone = (here == 32) | (here == 10)
            lone &= ~T.BLANK[ahead] & ~T.BLANK[behind] & ~_MAY_BE_SPACE[ahead] & (ahead > 31) & (behind > 31)
            wide = np.flatnonzero(lone & (behind >= 128))  # the character before has several bytes
            two, three = data[np.maximum(wide - 1, 0)], data[np.maximum(wide - 2, 0)]
            lone[wide[(two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3))]] = False
            cut[1:-2] = lone
            cut[2:-1] |= lone & (here == 10)
            cut[1:-1] |= _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        key, at, which = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > CACHE_CHUNKS:
            self.clear()
        keys = key.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            self._add(key[new], data, starts[at[new]], ends[at[new]])
        slot = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[which]
        sizes = self.sizes[slot]
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[slot] - (total - sizes), sizes) + np.arange(total[-1])]
        chunk_ends = np.concatenate([[0], total])
        return ids, chunk_ends[np.searchsorted(starts, offsets[1:])]


#: Lead bytes of white space outside ASCII, and of other characters.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION[33:127] = True
_PUNCTUATION[48:58] = _PUNCTUATION[65:91] = _PUNCTUATION[97:123] = False
_PUNCTUATION[ord("|")] = False  # the special token has one after a letter

_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than ``capacity``.

    All pieces of a longer document but the first hold ``capacity`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in T.blocks(batches, "text"):
            ids, ends = encode(batch.column("text"))
            ids = np.insert(ids, ends, end_id).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            doc, piece, start, length, crc = [], [], [], [], []
            begin = 0
            for own, end in zip(batch.column("id").to_pylist(), ends.tolist()):
                n = end - begin
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    doc.append(own)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[begin + a : begin + b].tobytes()))
                begin = end
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.record_batch(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


#: Pieces and slots in a range, which a task sorts and matches in memory (some 30 bytes each).
RANGE_ROWS = 1 << 18
_PLACED, _PIECE, _SLOT = 0, 1, 2


def brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of opening, places of closing brackets) that match, of a row of brackets."""
    depth = np.cumsum(np.where(opens, 1, -1))
    level = depth + ~opens
    order = np.argsort(level, kind="stable")
    here, there = order[:-1], order[1:]
    pair = (level[here] == level[there]) & opens[here] & ~opens[there]
    return here[pair], there[pair]


def _swept(items: DataFrame, parts: int) -> DataFrame:
    """Match pieces and slots (is_slot, size, id) inside size ranges: (part, role, id, size, sequence, nth).

    ``nth`` counts a range's left-over pieces and slots, each from 0 in the order of size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_slot", "size", "id")] for batch in batches if batch.num_rows]
        if not got:
            return
        slot, size, own = (np.concatenate(column) for column in zip(*got))
        pieces, slots = brackets(~slot)
        left = np.ones(len(slot), bool)
        left[pieces] = left[slots] = False
        for role, at, sequence in (
            (_PLACED, pieces, own[slots]),
            (_PIECE, np.flatnonzero(left & ~slot), None),
            (_SLOT, np.flatnonzero(left & slot), None),
        ):
            columns = [
                pa.array(np.full(len(at), role), pa.int32()),
                pa.array(own[at], pa.int64()),
                pa.array(size[at], pa.int64()),
                pa.nulls(len(at), pa.int64()) if sequence is None else pa.array(sequence, pa.int64()),
                pa.array(np.arange(len(at)), pa.int64()),
            ]
            yield from pa.Table.from_arrays(columns, ["role", "id", "size", "sequence", "nth"]).to_batches(1 << 16)

    order = ["size", "is_slot", "id"]
    ranges = items.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranges.mapInArrow(run, "role int, id bigint, size bigint, sequence bigint, nth bigint").withColumn("part", F.spark_partition_id())


def _across(swept: DataFrame) -> DataFrame | None:
    """Left-over pieces (id, size) with the ``sequence`` of the slot of a later range, or null; None if no range has one."""
    counts = {(r["part"], r["role"]): r["count"] for r in swept.where(F.col("role") != _PLACED).groupBy("part", "role").count().collect()}
    with_pieces = [part for part, role in counts if role == _PIECE]
    with_slots = [part for part, role in counts if role == _SLOT]
    if not with_pieces or not with_slots or min(with_pieces) >= max(with_slots):
        return None
    depth, base = 0, []
    for part in sorted({part for part, _ in counts}):
        after = depth - counts.get((part, _SLOT), 0)
        base.append((part, depth, after))
        depth = after + counts.get((part, _PIECE), 0)
    base = swept.sparkSession.createDataFrame(base, "part int, before bigint, after bigint")  # a row for each range
    is_piece = F.col("role") == _PIECE
    left = swept.where((is_piece & (F.col("part") < max(with_slots))) | ((F.col("role") == _SLOT) & (F.col("part") > min(with_pieces))))
    level = F.when(is_piece, F.col("after") + F.col("nth") + 1).otherwise(F.col("before") - F.col("nth"))
    left = left.join(F.broadcast(base), "part").withColumn("level", level)
    nesting = Window.partitionBy("level").orderBy("part", F.desc("role"))  # at most two rows of each range
    mate = F.when(F.lead("role").over(nesting) == _SLOT, F.lead("id").over(nesting))
    found = left.select("role", "id", "size", mate.alias("sequence")).where(is_piece).drop("role")
    return found.unionByName(swept.where(is_piece & (F.col("part") >= max(with_slots))).select("id", "size", "sequence"))


def _band(longest: int, capacity: int) -> tuple[int, int]:
    """(how many of the longest fit into a sequence, the length below which pieces wait for the next band)."""
    fit = capacity // longest
    return fit, capacity // max(fit + 1, fit * 3 // 2)


def _openings(lengths: dict[int, int], free: dict[int, int], capacity: int) -> int:
    """How many empty sequences the longest pieces need that no gap takes; short pieces also get what all of them lack."""
    longest, widest = max(lengths), max(free, default=0)
    fit, low = _band(longest, capacity)
    needed = -(-sum(n for length, n in lengths.items() if length > max(low, widest)) // fit) if longest > widest else 0
    if 4 * longest <= capacity:
        lack = sum(length * n for length, n in lengths.items()) - sum(gap * n for gap, n in free.items())
        needed = max(needed, -(-lack // capacity))
    return needed


def pack(rows: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a ``length`` of at most ``capacity``."""
    spark = rows.sparkSession
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = [rows.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"))]  # they fill sequences of their own
    pieces = rows.where(F.col("length") < capacity).select(F.col("row").alias("id"), F.col("length").cast("bigint").alias("size"))
    gaps, opened = spark.createDataFrame([], "id bigint, size bigint"), 0
    while True:
        both = pieces.select("size", F.lit(False).alias("is_slot")).unionByName(gaps.select("size", F.lit(True).alias("is_slot")))
        counts = both.groupBy("is_slot", "size").count().collect()  # at most 2 * ``capacity`` rows
        lengths = {r["size"]: r["count"] for r in counts if not r["is_slot"]}
        free = {r["size"]: r["count"] for r in counts if r["is_slot"]}
        if not lengths:
            break
        new, longest, shortest = _openings(lengths, free, capacity), max(lengths), min(lengths)
        if new:
            gaps = gaps.unionByName(spark.range(opened, opened + new).select("id", F.lit(capacity).cast("bigint").alias("size")))
            free[capacity] = free.get(capacity, 0) + new
            opened += new
        many = F.greatest(F.floor(F.col("size") / longest), F.lit(1))
        sizes = F.array_repeat(F.floor(F.col("size") / many), many.cast("int"))  # equal, so that neighbours by rank share a sequence
        slots = gaps.where(F.col("size") >= shortest).select("id", F.explode(sizes).alias("size"), F.lit(True).alias("is_slot"))
        total = sum(lengths.values()) + sum(n * max(gap // longest, 1) for gap, n in free.items() if gap >= shortest)
        items = pieces.withColumn("is_slot", F.lit(False)).unionByName(slots)
        parts = -(-total // range_rows)
        swept = stored(_swept(items, parts), "swept")
        matched = swept.where(F.col("role") == _PLACED).select("id", "size", "sequence")
        across = _across(swept)  # by the ranges that Spark made, which may be more than asked for
        if across is None:
            pieces = swept.where(F.col("role") == _PIECE).select("id", "size")
        else:
            across = stored(across, "across")
            matched = matched.unionByName(across.where("sequence is not null"))
            pieces = across.where("sequence is null").select("id", "size")
        placed.append(matched.select(F.col("id").alias("row"), F.col("sequence").alias("sequence_id")))
        taken = matched.select(F.col("sequence").alias("id"), (-F.col("size")).alias("size"))
        gaps = gaps.unionByName(taken).groupBy("id").agg(F.sum("size").alias("size")).where(F.col("size") >= shortest)
        gaps = stored(gaps, "gaps")
    places = reduce(DataFrame.unionByName, placed)
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    return rows.join(places, "row").withColumn("offset", offset).drop("row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    out = pack(pieces(docs, tokenizer_path, capacity, **columns), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
