"""Vector code compression: one codebook a part position, fitted by k-means with adaptive bounds.

A vector's components become integers ``floor(4096 * x)`` and it is cut into equal
parts. A part's state (Drake and Hamerly) is its nearest entry with an upper bound
of the distance, its next ``b`` nearest entries with lower bounds in ascending order,
and one outer lower bound for all other entries. When entries move, each bound
gives way by what its entry moved, the outer one by the largest movement. A part

* keeps its entry if the upper bound is below its first lower bound,
* else measures its own entry and, if that isn't enough, the listed entries up to the
  first bound that is above the upper bound,
* and only if no bound is, measures all entries and gets a new list.

Bounds are rounded outwards and must differ to decide; what they leave open is
decided by exact integer distances, ties to the lower index. After each round ``b``
follows the share of parts whose list was too short (:func:`adapted`).

The state is a table in the shared folder, written anew each round, so a lost
executor costs its tasks of one round. The driver holds the codebooks (parts x
entries x components, whatever the number of vectors) and sums of the same shape.

Cases: rows whose vector is null, or has null or non-finite components, are dropped.
Repeated ids are vectors of their own, the first entries going by id (null last),
then by components; with fewer vectors than entries, the codebooks have as many
entries as there are vectors. Entries that no part is nearest to stay as they are.
An empty table gives no rows. Kept vectors must share a length that is a multiple of
the number of parts, and components must be so small that distances fit 64 bits;
otherwise a ValueError tells so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entry number of a place in a part's list that holds none.
NONE = 255

STATE = "vec_id bigint, label string, has_label boolean, vector binary, near binary, lower binary, upper binary, outer binary"


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and component."""

    entries: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.entries.shape

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def movements(self, later: Codebooks) -> np.ndarray:
        """At least the distance that each entry moves, by part and entry."""
        return _up(np.sqrt(((later.entries - self.entries) ** 2).sum(2).astype(np.float64)))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def kept_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, has_label, vector array<bigint>): the rows with whole finite vectors, as integers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col(label_col)
    return table.where(x.isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        label.cast("string").alias("label"),
        label.isNotNull().alias("has_label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("vector"),
    )


def _checked(vectors: DataFrame, parts: int) -> int:
    """The common length of the vectors; None of an empty table."""
    found = vectors.agg(
        F.min(F.size("vector")).alias("least"),
        F.max(F.size("vector")).alias("most"),
        F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("largest"),
    ).first()
    if found["least"] is None:
        return 0
    if found["least"] != found["most"] or not found["most"] or found["most"] % parts:
        raise ValueError(f"vectors of {found['least']} to {found['most']} components can't be cut into {parts} equal parts")
    if 4 * found["largest"] ** 2 * found["most"] >= 1 << 63:
        raise ValueError("components are too large for distances of 64 bits")
    return found["most"]


class Block:
    """The parts of a batch of vectors: ``x`` by vector, part and component, and their bounds."""

    def __init__(self, vectors: np.ndarray, books: Codebooks):
        parts, self.k, width = books.shape
        self.n = len(vectors)
        self.x = vectors.reshape(self.n * parts, width)
        self.part = np.tile(np.arange(parts), self.n)
        self.books = books

    def distances(self, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances of parts to the entries listed for each."""
        gap = self.x[rows][:, None, :] - self.books.entries[self.part[rows][:, None], entries]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def fresh(self, rows: np.ndarray, b: int) -> None:
        """Measure all entries and list the nearest ``b + 1``."""
        if not len(rows):
            return
        distance = self.distances(rows, np.broadcast_to(np.arange(self.k), (len(rows), self.k)))
        order = np.argsort(distance, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(distance, order, 1).astype(np.float64))
        listed = min(b + 1, self.k)
        self.near[rows] = NONE
        self.near[rows, :listed] = order[:, :listed]
        self.upper[rows] = _up(root[:, 0])
        self.outer[rows] = _down(root[:, listed]) if listed < self.k else np.inf
        self.lower[rows] = self.outer[rows][:, None]
        self.lower[rows, : listed - 1] = _down(root[:, 1:listed])

    def start(self, b: int) -> np.ndarray:
        """Measure every part against every entry; the parts that needed that."""
        m = len(self.x)
        self.near, self.lower = np.full((m, b + 1), NONE, np.uint8), np.full((m, b), np.inf, np.float32)
        self.upper, self.outer = np.zeros(m, np.float32), np.zeros(m, np.float32)
        self.fresh(np.arange(m), b)
        return np.zeros(b + 2, np.int64)

    def resized(self, b: int) -> None:
        """Make room for ``b`` bounds: the outer bound takes what is cut off, and fills new places."""
        old = self.lower.shape[1]
        if b < old:
            self.outer = np.minimum(self.outer, self.lower[:, b])
            self.lower, self.near = self.lower[:, :b], self.near[:, : b + 1]
        elif b > old:
            pad = b - old
            self.lower = np.concatenate([self.lower, np.repeat(self.outer[:, None], pad, 1)], 1)
            self.near = np.concatenate([self.near, np.full((len(self.near), pad), NONE, np.uint8)], 1)

    def advance(self, moved: np.ndarray, b: int) -> np.ndarray:
        """Reassign after the entries have moved; how many parts needed 0, 1, ..., b bounds, or (last) all entries."""
        largest = moved.max(1)[self.part]
        by_entry = np.concatenate([moved, np.repeat(moved.max(1)[:, None], NONE + 1 - self.k, 1)], 1)  # NONE gives way like the outer bound
        self.upper = _up(self.upper + by_entry[self.part, self.near[:, 0]])
        self.lower = _down(self.lower - by_entry[self.part[:, None], self.near[:, 1:]])
        self.outer = _down(self.outer - largest)
        self.resized(b)
        edge = np.concatenate([self.lower, self.outer[:, None]], 1)
        edge = np.minimum.accumulate(edge[:, ::-1], 1)[:, ::-1]  # ascending: each bound holds for all places after it
        self.lower, self.outer = edge[:, :-1].copy(), edge[:, -1].copy()
        need = np.zeros(b + 2, np.int64)
        open_ = np.flatnonzero(~(self.upper < edge[:, 0]))
        need[0] = len(self.x) - len(open_)
        if not len(open_):
            return need
        own = self.distances(open_, self.near[open_, :1])[:, 0]
        self.upper[open_] = _up(np.sqrt(own.astype(np.float64)))
        clear = self.upper[open_][:, None] < edge[open_]
        reach = np.where(clear.any(1), clear.argmax(1), b + 1)  # places before this one may hold a nearer entry
        for j in range(b + 2):
            rows = open_[reach == j]
            need[j] += len(rows)
            if j == b + 1 or not len(rows):
                self.fresh(rows, b)
            elif j:
                self._ranked(rows, j)
        return need

    def _ranked(self, rows: np.ndarray, j: int) -> None:
        """Measure the first ``j`` listed entries beside the own one, and order them."""
        entries = self.near[rows, : j + 1]
        distance = self.distances(rows, entries)
        order = np.lexsort((entries, distance), axis=1)
        root = np.sqrt(np.take_along_axis(distance, order, 1).astype(np.float64))
        self.near[rows, : j + 1] = np.take_along_axis(entries, order, 1)
        self.upper[rows] = _up(root[:, 0])
        self.lower[rows, :j] = _down(root[:, 1:])


def adapted(b: int, need: np.ndarray, entries: int) -> int:
    """The number of bounds of the next round.

    A list is longer by two if more than one part in ``entries`` ran through it,
    for then measuring everything costs more than the bounds. Else it shrinks to what
    covers all but that share, and at least an eighth of the entries.
    """
    allowed = need.sum() / entries
    if need[-1] > allowed:
        return min(b + 2, max(1, entries - 1))
    beyond = need[::-1].cumsum()[::-1]  # parts that need so many bounds or more
    least = max(1, entries // 8)
    return max(least, min((n for n in range(least, b + 1) if beyond[n + 1] <= allowed), default=b))


def _matrix(column: pa.Array, dtype, rows: int) -> np.ndarray:
    """Equal-sized binary values as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(rows, -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.nbytes // max(1, len(matrix)))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _state(batch: pa.RecordBatch, vectors: np.ndarray, block: Block) -> pa.RecordBatch:
    n = block.n
    columns = [_binary(a.reshape(n, -1)) for a in (block.near, block.lower, block.upper, block.outer)]
    return pa.record_batch([*(batch.column(c) for c in _NAMES[:3]), _binary(vectors), *columns], _NAMES)


def _loaded(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, Block]:
    n, (parts, _, _) = batch.num_rows, books.shape
    vectors = _matrix(batch.column("vector"), "<i8", n)
    block = Block(vectors, books)
    block.near = _matrix(batch.column("near"), np.uint8, n).reshape(n * parts, -1).copy()
    block.lower = _matrix(batch.column("lower"), "<f4", n).reshape(n * parts, -1).copy()
    block.upper = _matrix(batch.column("upper"), "<f4", n).ravel().copy()
    block.outer = _matrix(batch.column("outer"), "<f4", n).ravel().copy()
    return vectors, block


def _first(vectors: DataFrame, books: Codebooks, b: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                block = Block(whole, books)
                block.start(b)
                yield _state(batch, whole.astype("<i8"), block)

    return vectors.mapInArrow(run, STATE)


def _next(state: DataFrame, books: Codebooks, moved: np.ndarray, b: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, block = _loaded(batch, books)
                need = block.advance(moved, b)
                out = _state(batch, vectors, block)
                counts = np.zeros((batch.num_rows, len(need)), "<i8")
                counts[0] = need  # a batch's counts lie in its first row
                yield out.append_column("need", _binary(counts))

    return state.mapInArrow(run, f"{STATE}, need binary")


def _summed(state: DataFrame, books: Codebooks, b: int) -> tuple[Codebooks, np.ndarray]:
    """The entries' means, and how many parts needed how many bounds."""
    parts, k, width = books.shape
    measured = "need" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, need = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64), np.zeros(b + 2, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = _matrix(batch.column("near"), np.uint8, n).reshape(n, parts, -1)[:, :, 0]
            slot = (np.arange(parts) * k + code).ravel()
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            at = slot[order][starts]
            sums[at] += np.add.reduceat(_matrix(batch.column("vector"), "<i8", n).reshape(n * parts, width)[order], starts)
            counts += np.bincount(slot, minlength=parts * k)
            if measured:
                need += _matrix(batch.column("need"), "<i8", n).sum(0)
        slots = [pa.array(np.arange(parts * k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))]
        yield pa.record_batch(slots, ["slot", "n", "sums"])
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([need.tolist()], pa.list_(pa.int64()))], ["slot", "n", "sums"])

    each = state.select("vector", "near", *(["need"] if measured else [])).mapInArrow(run, "slot int, n bigint, sums array<bigint>")
    each = each.select("slot", "n", F.posexplode("sums").alias("position", "value"))
    totals = each.groupBy("slot", "position").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    entries, need = books.entries.reshape(parts * k, width).copy(), np.zeros(b + 2, np.int64)
    for r in totals.collect():  # parts * entries * components rows
        if r["slot"] < 0:
            need[r["position"]] = int(r["value"])
        elif r["n"]:
            entries[r["slot"], r["position"]] = int(r["value"]) // r["n"]
    return Codebooks(entries.reshape(parts, k, width)), need


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds`` updates, and the state with every part's final assignment."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    k = len(first)
    b = max(1, k // 4)
    state = stored(_first(vectors, books, b), "codes")
    for _ in range(rounds):
        later, need = _summed(state, books, b)
        moved = books.movements(later)
        unmoved = np.array_equal(later.entries, books.entries)
        books = later
        if unmoved:  # the same entries get the same parts ever after
            break
        if need.any():
            b = adapted(b, need, k)
        following = stored(_next(state, books, moved, b), "codes")
        dropped(state)
        state = following
    return books, state


def compress(
    table: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    spark = table.sparkSession
    vectors = kept_vectors(table, id_col, vector_col, label_col)
    width = _checked(vectors, parts)
    if not width:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books, state = fit(vectors, width, parts, entries, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            _, block = _loaded(batch, books)
            error = block.distances(np.arange(n * parts), block.near[:, :1]).reshape(n, parts).sum(1)
            code = [bytes(r).hex() for r in np.ascontiguousarray(block.near[:, 0].reshape(n, parts))]
            columns = [batch.column(c) for c in _NAMES[:3]]
            yield pa.record_batch([*columns, pa.array(code), pa.array(error)], [*_NAMES[:3], "code", "error"])

    coded = state.select(*_NAMES).mapInArrow(run, "vec_id bigint, label string, has_label boolean, code string, error bigint")
    coded = stored(coded, "coded")
    dropped(state)
    # one row a label; a hot label's rows are summed where they lie, and joined without a shuffle while the labels are few
    key = F.when(F.col("has_label"), F.concat(F.lit("="), "label")).otherwise("").alias("key")
    sums = stored(coded.groupBy(key).agg(F.sum("error").alias("label_error")), "labels")
    joined = coded.withColumn("key", key).join(small(sums, 100), "key")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
