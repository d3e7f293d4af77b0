"""Fuzzy line dedup: MinHash over character shingles, banding, exact verification, distributed union-find.

A line is lower-cased (A-Z) and stripped of blanks at its ends. Equal lines fold
together by a 128-bit hash, first inside each task, then over the whole table. Of
each distinct line, one pass over its character shingles gives a one-permutation
MinHash signature (the least hash of each of ``bands * rows`` bins, empty bins borrowing from
the next full one); lines that agree on a whole band are candidates, the Jaccard
similarity of their whole shingle sets decides (:mod:`.linking`), and connected
components keep their first line by (document id, hash of the text, line number).
With 12 bands of 4 rows, lines of similarity 0.8 meet with a chance of 0.998.

A row is known by its id and a 64-bit hash of its text, so rows that share an id but not the
text are deduplicated like any others.

Cases: lines of fewer than ``min_chars`` characters (by default those shorter than
one shingle: blank lines, braces) are always kept; a null text has no lines and stays null; rows
without id come after all others; rows that repeat with id and text are treated alike: what
one of them keeps, all keep; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counters, packed
from . import textops as T
from .linking import first_pairs, link
from .scratch import small, stored, unused

SHINGLE, MIN_CHARS, BANDS, ROWS = 8, 8, 12, 4
NUM, DEN = 4, 5

#: Bytes of text whose lines a task folds at once, and characters that it signs at once.
FOLD_BYTES, SIGN_CHARS = 1 << 23, 1 << 18

_BLANKS = b" \t\r\x0b\x0c"
_PLACE = [("doc", "<i8"), ("key", "<i8"), ("line", "<i4"), ("null", "u1")]
_GONE, _NODE = np.dtype(_PLACE), np.dtype([("node", "<i8"), *_PLACE])
_BAND = np.dtype([("key", "<u8"), ("order", "u1"), ("node", "<i8")])
_BEFORE = ("line", "key", "doc", "null")

_CHAR_VALUE = T.mix(np.arange(1 << 16, dtype=np.uint64) * T._ODD + np.uint64(1))


def _line_dtype(bands: int) -> np.dtype:
    return np.dtype([("h1", "<u8"), ("h2", "<u8"), *_PLACE, ("times", "<u4"), ("bands", "<u8", (bands,))])


def _points(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines one after another, and each line's length in them."""
    whole = b"".join(lines)
    if whole.isascii():
        return np.frombuffer(whole, np.uint8), np.fromiter(map(len, lines), np.int64, len(lines))
    size = [len(x) if x.isascii() else len(x.decode()) for x in lines]
    return np.frombuffer(whole.decode().encode("utf-32-le"), "<u4"), np.array(size, np.int64)


def rolling(value: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every run of ``size`` values, by doubling."""
    out, done, power = None, 0, T._BASE
    run, length = value, 1
    while size:
        if size & 1:
            if out is None:
                out, done = run, length
            else:
                n = len(value) - done - length + 1
                out = out[:n] * np.uint64(power) + run[done : done + n]
                done += length
        size >>= 1
        if size:
            n = len(run) - length
            if n <= 0:
                return np.zeros(0, np.uint64)
            run = run[:n] * np.uint64(power) + run[length:]
            length, power = 2 * length, power * power & 0xFFFFFFFFFFFFFFFF
    return out


def char_shingles(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line): the runs of ``size`` characters of each line; lines must not be shorter."""
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points, length = _points(lines)
    if points.dtype == np.uint8 or int(points.max()) < 1 << 16:
        value = _CHAR_VALUE[points]
    else:
        value = T.mix(points.astype(np.uint64) * T._ODD + np.uint64(1))
    hashed = rolling(value, size)
    keep = np.ones(len(points), bool)
    keep[(np.cumsum(length)[:, None] - np.arange(1, size)).reshape(-1)] = False
    hashed = hashed[keep[: len(hashed)]]
    hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashed ^ (hashed >> np.uint64(32)), np.repeat(np.arange(len(lines)), length - (size - 1))


def band_keys(value: np.ndarray, line: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """n x bands: a hash of each band of each line's signature."""
    bins = bands * rows
    place = (value >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)
    least = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, line * bins + place.astype(np.int64), value & np.uint64(0xFFFFFFFFFF))
    least = np.ascontiguousarray(least.reshape(n, bins).T)
    empty = least == np.iinfo(np.uint64).max
    for _ in range(2):  # the second turn goes on past the end
        for b in range(bins - 1, -1, -1):
            of = (b + 1) % bins
            take = empty[b] & ~empty[of]
            least[b, take] = least[of, take] + np.uint64(1 << 41)
            empty[b, take] = False
    out = np.zeros((n, bands), np.uint64)
    for k in range(bands):
        acc = np.full(n, k + 1, np.uint64)
        for j in range(rows):
            acc = T.mix(acc * T._ODD + least[k * rows + j])
        out[:, k] = acc
    return out


def signed(lines: list[bytes], shingle: int, bands: int, rows: int) -> np.ndarray:
    """len(lines) x bands: the band keys of all lines."""
    out, start, total = [np.zeros((0, bands), np.uint64)], 0, 0
    for i, line in enumerate(lines):
        total += len(line)
        if total >= SIGN_CHARS or i == len(lines) - 1:
            part = lines[start : i + 1]
            out.append(band_keys(*char_shingles(part, shingle), len(part), bands, rows))
            start, total = i + 1, 0
    return np.concatenate(out)


def _lines(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(number, line) of the lines that count."""
    for k, line in enumerate(text.lower().split(b"\n")):
        line = line.strip(_BLANKS)
        if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
            yield k, line


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = T.utf8(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b].tobytes()


def _same(records: np.ndarray, *names: str) -> np.ndarray:
    """Whether each record agrees with the one before in all of ``names``."""
    same = np.zeros(len(records), bool)
    if len(records):
        same[1:] = np.logical_and.reduce([records[c][1:] == records[c][:-1] for c in names])
    return same


def _folded(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, gone): the order by line and place; in it, which open a class, and which are others of it."""
    order = np.lexsort([records[c] for c in (*_BEFORE, "h2", "h1")])
    own = records[order]
    later = _same(own, "h1", "h2")
    return order, ~later, later & ~_same(own, "h1", "h2", *_BEFORE)


def _gone(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), _GONE)
    for c in _BEFORE:
        out[c] = records[c]
    return out


def _candidates(docs: DataFrame, min_chars: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """Rows of three kinds: 0, places (doc, key, line) of lines whose equal stands earlier; 1, the
    distinct lines: node, and where they stand first; 2, pairs (node, p, star) of them that share a band."""
    dtype = _line_dtype(bands)
    n_docs = docs.count()
    n_lines, n_bands = packed.buckets(n_docs, 2_000), packed.buckets(n_docs, 500)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[bytes] = []
        place: list[tuple] = []

        def folded() -> Iterator[pa.RecordBatch]:
            records = np.zeros(len(lines), dtype)
            for k, c in enumerate(("doc", "key", "line", "null")):
                records[c] = [x[k] for x in place]
            h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<u8").reshape(-1, 2)
            records["h1"], records["h2"] = h[:, 0], h[:, 1]
            order, first, gone = _folded(records)
            own = records[order[first]]
            own["times"] = np.diff(np.append(np.flatnonzero(first), len(records)))
            own["bands"] = signed([lines[i] for i in order[first].tolist()], shingle, bands, rows)
            yield packed.rows(packed.deal(own["h1"], n_lines), own, 1)
            if gone.any():
                left = _gone(records[order[gone]])
                yield packed.rows(np.full(len(left), int(left["key"][0]) % n_lines), left, 0)
            lines.clear()
            place.clear()

        total = 0
        for batch in T.blocks(batches, "text"):
            docs_, keys = batch.column("doc").to_pylist(), batch.column("key").to_pylist()
            for doc, key, text in zip(docs_, keys, _texts(batch.column("text"))):
                for k, line in _lines(text, min_chars):
                    lines.append(line)
                    place.append((doc or 0, key, k, doc is None))
                total += len(text)
            if total >= FOLD_BYTES:
                yield from folded()
                total = 0
        if lines:
            yield from folded()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, pieces in packed.by_bucket(batches):
            parts = [np.zeros(0, dtype)]
            for kind, column in pieces:
                if kind == 0:
                    yield _one(bucket, packed.unpack(column, _GONE), 0)
                else:
                    parts.append(packed.unpack(column, dtype))
            records = np.concatenate(parts)
            order, first, gone = _folded(records)
            own = records[order]
            if gone.any():
                yield _one(bucket, _gone(own[gone]), 0)
            start = np.flatnonzero(first)
            if not len(start):
                continue
            if len(start) > 1 << 24:
                raise ValueError("a bucket of lines is too large; there must be more documents than were counted")
            times = np.add.reduceat(own["times"].astype(np.int64), start)
            node = np.zeros(len(start), _NODE)
            for c in _BEFORE:
                node[c] = own[c][start]
            node["node"] = bucket << 24 | np.arange(len(start))
            yield _one(bucket, node, 1)
            band = np.zeros((len(start), bands), _BAND)
            band["key"] = own["bands"][start]
            band["order"] = 255 - np.minimum(255, 8 * np.log2(times)).astype(np.int64)[:, None]
            band["node"] = node["node"][:, None]
            band = band.reshape(-1)
            yield packed.rows(packed.deal(band["key"], n_bands), band, 2)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in packed.by_bucket(batches):
            ahead = next(pieces, None)
            while ahead is not None and ahead[0] < 2:
                kind, column = ahead
                records = packed.unpack(column, _NODE if kind else _GONE)
                node = pa.array(records["node"].copy()) if kind else pa.nulls(len(records), pa.int64())
                doc = pa.array(records["doc"].copy(), mask=records["null"] == 1)
                yield pa.record_batch(
                    [pa.array(np.full(len(records), kind, np.int32)), node, pa.nulls(len(records), pa.int64()), pa.nulls(len(records), pa.bool_()),
                     doc, pa.array(records["key"].copy()), pa.array(records["line"].copy())],
                    _FOUND,
                )
                ahead = next(pieces, None)
            if ahead is None:
                continue
            chunks = (packed.unpack(column, _BAND) for _, column in itertools.chain([ahead], pieces))
            for pairs in first_pairs(chunks):
                n = pairs.num_rows
                longs = pa.nulls(n, pa.int64())
                yield pa.record_batch([pa.array(np.full(n, 2, np.int32)), *pairs.columns, longs, longs, pa.nulls(n, pa.int32())], _FOUND)

    first = packed.exchanged(docs.select("doc", "key", "text").mapInArrow(read, packed.SCHEMA))
    second = packed.exchanged(first.mapInArrow(fold, packed.SCHEMA))
    return second.mapInArrow(meet, "kind int, node bigint, p bigint, star boolean, doc bigint, key bigint, line int")


_FOUND = ["kind", "node", "p", "star", "doc", "key", "line"]


def _one(bucket: int, records: np.ndarray, kind: int) -> pa.RecordBatch:
    return packed.rows(np.full(len(records), bucket), records, kind)


def _contents(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, content, block, cells): the lines whose numbers are in ``lines``, stripped and in lower case; and, in
    rows with ``block``, each task's counters of their shingles."""
    read = _reader(shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["node", "content", "block", "cells"], counters.Counts()
        for batch in T.blocks(batches, "text"):
            node, content = [], []
            for own, numbers, text in zip(batch.column("nodes").to_pylist(), batch.column("lines").to_pylist(), _texts(batch.column("text"))):
                parts = text.lower().split(b"\n")
                node += own
                content += [parts[k].strip(_BLANKS) for k in numbers]
            column = pa.array(content, pa.binary())
            for start in range(0, len(content), 1024):
                counts.add(read(column.slice(start, 1024))[0])
            yield pa.record_batch([pa.array(node, pa.int64()), column, pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.binary())], names)
        for block, cells in counts.blocks():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([block], pa.int64()), pa.array([cells], pa.binary())], names)

    return docs.mapInArrow(run, "node bigint, content binary, block bigint, cells binary")


def _reader(shingle: int):
    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(elements, cut): the sorted shingles of each line's text."""
        value, line = T.distinct(*char_shingles(column.to_pylist(), shingle))
        order = np.lexsort((value, line))
        return value[order], np.searchsorted(line[order], np.arange(len(column) + 1))

    return read


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def duplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    min_chars: int = MIN_CHARS,
    bands: int = BANDS,
    rows: int = ROWS,
    num: int = NUM,
    den: int = DEN,
) -> DataFrame:
    """(doc, key, line): the lines that are not the first of their component; key is xxhash64 of the document's text."""
    if min_chars < shingle:
        raise ValueError("lines must have a shingle at least")
    docs = _keyed(docs, id_col, text_col).where("text is not null")
    found = stored(_candidates(docs, min_chars, shingle, bands, rows), "lines")
    gone = found.where("kind = 0").select("doc", "key", "line")
    pairs = stored(found.where("kind = 2").groupBy(F.col("node").alias("x"), "p").agg(F.max("star").alias("star")), "pairs")
    if pairs.isEmpty():
        return gone
    nodes = found.where("kind = 1").select("node", "doc", "key", "line")
    wanted = stored(pairs.select(F.explode(F.array("x", "p")).alias("node")).distinct(), "candidates")
    wanted = nodes.join(small(wanted, 16), "node", "left_semi")
    wanted = wanted.groupBy("doc", "key").agg(F.collect_list("line").alias("lines"), F.collect_list("node").alias("nodes"))
    wanted = stored(wanted.withColumnRenamed("doc", "__doc").withColumnRenamed("key", "__key"), "wanted")
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key"))
    held, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    texts = docs.join(small(wanted, 48 + 12 * (size // max(held, 1) + 1)), same).select("text", "lines", "nodes")
    gathered = stored(_contents(texts, shingle), "contents")
    popularity = docs.sparkSession.sparkContext.broadcast(counters.merged(gathered.where("block is not null")))
    items = gathered.where("block is null").select("node", "content").dropDuplicates(["node"])
    labels = link(pairs, items, _reader(shingle), popularity, num, den)
    if labels is None:
        return gone
    members = nodes.join(labels, "node").withColumn("own", F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "line"))
    keepers = members.groupBy("component").agg(F.min("own").alias("keeper"))
    return gone.unionByName(members.join(keepers, "component").where("own <> keeper").select("doc", "key", "line"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with the duplicate lines left out of the text, and n_lines, n_dropped added (in place of such columns)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    dropped = duplicate_lines(docs, id_col, text_col, **parameters)
    of, mark, gone_lines = unused(docs, "own_doc", "own_key", "own_lines")
    dropped = dropped.groupBy(F.col("doc").alias(of), F.col("key").alias(mark)).agg(F.collect_set("line").alias(gone_lines))
    dropped = stored(dropped, "dropped")
    rows, size = dropped.agg(F.count("*"), F.coalesce(F.sum(F.size(gone_lines)), F.lit(0))).first()
    same = docs[id_col].cast("bigint").eqNullSafe(F.col(of)) & (F.xxhash64(docs[text_col]) == F.col(mark))
    joined = docs.join(small(dropped, 48 + 4 * (size // max(rows, 1) + 1)), same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, text_col):
            texts, n_lines, n_dropped = [], [], []
            for text, lines in zip(batch.column(text_col).to_pylist(), batch.column(gone_lines).to_pylist()):
                parts = [] if text is None else text.split("\n")
                gone = set(lines or ()) if text is not None else set()
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
                n_lines.append(len(parts))
                n_dropped.append(len(gone))
            arrays = [batch.column(c) if c != text_col else pa.array(texts, batch.column(c).type) for c in own]
            yield pa.record_batch([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return joined.select(*[docs[c] for c in own], gone_lines).mapInArrow(run, schema + ", n_lines bigint, n_dropped bigint")
