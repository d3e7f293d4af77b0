"""Removal of long passages that repeat anywhere in a corpus, by compressed FM-indexes.

A window is a run of ``window`` words; it is removed if an equal one starts earlier, that
is at a smaller (doc_id, position). Equal windows have the same minimizer, the
smallest hash of their runs of ``gram`` words, so windows are dealt by it: a segment is a
run of windows with one minimizer occurrence. Four steps, each a table in the shared
folder or a shuffle:

1. every segment sends a record of its minimizer, content hash and place. Equal
   contents that meet in a task are folded: all but the earliest are surely repeats;
2. minimizers that occur once in the corpus drop out, for their windows have no
   equals; of equal contents the earliest stays a candidate;
3. the words of the candidates go to the shard of their minimizer. A shard builds an
   :class:`~.fm_index.FmIndex` of its segments, streams them through backward
   search, and reports the windows whose interval holds an earlier one. A minimizer of
   more than ``HOT`` contents is dealt by whole windows instead, over many shards;
4. the reported windows meet the documents.

Documents are joined by id and a hash of the text. Hashes of words have 64 bits.

Cases: null and empty texts have no words. Windows at the same id and position (repeated rows,
or texts that share an id) aren't earlier than one another. A null id comes last.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from . import textops as T
from .fm_index import FmIndex
from .scratch import stored

WINDOW, GRAM = 20, 10
#: Words of an index shard, and contents of a minimizer beyond which its windows are dealt one by one.
SHARD_WORDS, HOT = 200_000, 2_000
#: Folded contents that a task remembers.
KEPT_CONTENTS = 1 << 20
#: Text bytes to one record of step 1, roughly.
RECORD_BYTES = 32

_NULL_ID = np.iinfo(np.int64).max
_RECORD = np.dtype([("gram", "<u4"), ("content", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("start", "<u4"), ("n", "<u1")])


def _sequence_hashes(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words."""
    base, inverse = 0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * T._power_table(base, len(word)), out=total[1:])
    return T.mix((total[ends] - total[starts]) * T._power_table(inverse, len(word) + 1)[starts] + (ends - starts).astype(np.uint64))


def segments(word: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer) of all segments of rows of words; ``start`` counts over all rows."""
    n = len(word) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = len(word) - gram + 1
    hashed = np.zeros(grams, np.uint64)
    for i in range(gram):
        hashed = hashed * np.uint64(T._BASE) + word[i : i + grams]
    hashed = T.mix(hashed)
    least, at = hashed[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - gram + 1):
        better = hashed[k : k + n] < least
        np.copyto(least, hashed[k : k + n], where=better)
        at[better] = k
    at += np.arange(n)
    row = T.row_of(first)[:n]
    valid = np.arange(n) + window <= first[1:][row]
    begins = valid.copy()
    begins[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(begins)
    windows = np.diff(np.append(np.cumsum(valid)[starts] - 1, valid.sum()))
    return starts, windows, least[starts]


class _Folds:
    """Contents that a task has met more than once in a block, with the earliest place."""

    def __init__(self):
        self.content, self.doc, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, r: np.ndarray) -> np.ndarray:
        """Which records surely come after an equal content."""
        order = np.lexsort((r["start"], r["doc"], r["content"]))
        content, doc, start = r["content"][order], r["doc"][order], r["start"][order].astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        sizes = np.diff(np.append(begins, len(r)))
        least_doc, least_start = doc[begins], start[begins]
        if len(self.content):
            k = np.minimum(np.searchsorted(self.content, content[begins]), len(self.content) - 1)
            known = (self.content[k] == content[begins]) & ((self.doc[k] < least_doc) | ((self.doc[k] == least_doc) & (self.start[k] < least_start)))
            least_doc, least_start = np.where(known, self.doc[k], least_doc), np.where(known, self.start[k], least_start)
        out = np.empty(len(r), bool)
        out[order] = (doc > np.repeat(least_doc, sizes)) | (start > np.repeat(least_start, sizes))
        many = sizes > 1
        if many.any():
            if len(self.content) > KEPT_CONTENTS:
                self.__init__()
            both = np.concatenate([self.content, content[begins][many]])
            docs, starts = np.concatenate([self.doc, least_doc[many]]), np.concatenate([self.start, least_start[many]])
            order = np.lexsort((starts, docs, both))
            keep = order[np.concatenate([[True], np.diff(both[order]) != 0])]
            self.content, self.doc, self.start = both[keep], docs[keep], starts[keep]
        return out


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tag"), text.alias("text"))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, hashes of words, first)."""
    data, offsets = T.utf8(batch.column("text"))
    starts, ends, first = T.spans(data, offsets, T.BLANK)
    return data, starts, ends, T.hashes(data, starts, ends), first


_TEXT_BATCH = 1 << 21


def _records(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Step 1: kind 0, records by minimizer; kind 1, records that surely are repeats, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = _Folds()
        for batch in T.blocks(batches, "text", _TEXT_BATCH):
            _, _, _, word, first = _words(batch)
            start, n, least = segments(word, first, window, gram)
            if not len(start):
                continue
            row = np.searchsorted(first, start, "right") - 1
            r = np.zeros(len(start), _RECORD)
            r["gram"], r["content"], r["n"] = least, _sequence_hashes(word, start, start + n + window - 1), n
            r["doc"] = batch.column("doc_id").fill_null(_NULL_ID).to_numpy()[row]
            r["tag"] = batch.column("tag").to_numpy()[row]
            r["start"] = start - first[row]
            bucket = packed.deal(least, buckets)
            later = folds.later(r)
            yield packed.rows(bucket[~later], r[~later], 0)
            if later.any():
                yield packed.rows(packed.deal(T.mix(r["doc"][later].view(np.uint64)), buckets), r[later], 1)

    return docs.mapInArrow(run, packed.SCHEMA)


_FOUND = "doc_id bigint, tag int, start int, n int, hot boolean"
#: hot is null for windows that are removed; for candidates, whether their minimizer is hot.
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _found(doc, tag, start, n, hot) -> pa.RecordBatch:
    doc = np.asarray(doc)
    columns = [pa.array(doc, mask=doc == _NULL_ID), pa.array(tag, pa.int32()), pa.array(np.asarray(start).astype(np.int32)), pa.array(np.asarray(n).astype(np.int32))]
    return pa.record_batch([*columns, pa.nulls(len(doc), pa.bool_()) if hot is None else pa.array(hot)], _FOUND_NAMES)


def _candidates(records: DataFrame, hot: int) -> DataFrame:
    """Step 2: repeats, and the earliest of each content whose minimizer occurs again."""

    def settled(r: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = r[np.lexsort((r["tag"], r["start"], r["doc"], r["content"], r["gram"]))]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        r = r[new]
        begins = np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
        group = np.cumsum(begins) - 1
        contents = begins | np.concatenate([[True], r["content"][1:] != r["content"][:-1]])
        of = np.flatnonzero(contents)[np.cumsum(contents) - 1]
        later = (r["doc"] != r["doc"][of]) | (r["start"] != r["start"][of])
        again = np.bincount(group)[group] > 1
        is_hot = np.bincount(group, contents)[group] > hot
        own = r[later]
        yield _found(own["doc"], own["tag"], own["start"], own["n"], None)
        keep = again & ~later
        own = r[keep]
        yield _found(own["doc"], own["tag"], own["start"], own["n"], is_hot[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in packed.by_bucket(batches):
            kept = []
            for kind, column in pieces:
                r = packed.unpack(column, _RECORD)
                if kind:
                    yield _found(r["doc"], r["tag"], r["start"], r["n"], None)
                else:
                    kept.append(r)
            if kept:
                yield from settled(np.concatenate(kept))

    return packed.exchanged(records).mapInArrow(run, _FOUND)


def _by_document(found: DataFrame) -> DataFrame:
    """(doc_id, tag, spans) with ``spans`` the (start, n, hot) of a document."""
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "hot")).alias("spans"))


def _with_spans(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents (doc_id, tag, text, spans)."""
    spans = _by_document(found).withColumnsRenamed({"doc_id": "own_id", "tag": "own_tag"})
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tag") == F.col("own_tag"))
    return docs.join(spans, same, how).select("doc_id", "tag", "text", "spans")


_SEGMENT = "bucket bigint, doc_id bigint, tag int, start int, n int, words binary"
_SEGMENT_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]


def _segment_words(wanted: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Step 3: the candidates' words, by the shard of their minimizer, or window by window if that is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text", _TEXT_BATCH):
            _, _, _, word, first = _words(batch)
            start, n, least = segments(word, first, window, gram)
            spans = batch.column("spans")
            own = spans.flatten()
            row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy())
            begin = first[row] + own.field("start").to_numpy(zero_copy_only=False)
            at = np.searchsorted(start, begin)
            count, hot = n[at], own.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            key = least[at]
            each = np.where(hot, count, 1)  # of a hot minimizer, every window goes its own way
            k = np.repeat(np.arange(len(begin)), each)
            begin = begin[k] + np.arange(len(k)) - (np.cumsum(each) - each)[k]
            count = np.where(hot[k], 1, count[k])
            key = np.where(hot[k], _sequence_hashes(word, begin, begin + window), key[k])
            size = count + window - 1
            ends = np.cumsum(size)
            for a, b in zip(range(0, len(k), 20_000), [*range(20_000, len(k), 20_000), len(k)]):
                part = np.arange(a, b)
                total = size[part].sum()
                flat = word[np.repeat(begin[part] - (ends[part] - size[part] - (ends[a] - size[a])), size[part]) + np.arange(total)]
                offsets = np.concatenate([[0], np.cumsum(size[part])]).astype(np.int32) * np.int32(8)
                words = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype("<u8").tobytes())])
                of = pa.array(row[k[part]])
                yield pa.record_batch(
                    [pa.array(packed.deal(key[part], buckets)), batch.column("doc_id").take(of), batch.column("tag").take(of),
                     pa.array((begin[part] - first[row[k[part]]]).astype(np.int32)), pa.array(count[part].astype(np.int32)), words],
                    _SEGMENT_NAMES,
                )

    return wanted.mapInArrow(run, _SEGMENT)


def repeated(word: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, position in it) of the windows that start earlier elsewhere, of segments of a shard.

    ``word`` holds the segments' words one after the other, ``size`` their numbers of words, and
    ``doc`` and ``start`` their places.
    """
    symbols = np.zeros(len(word) + len(size), np.int64)
    own = np.repeat(np.arange(len(size)), size)
    symbols[np.arange(len(word)) + own] = np.unique(word, return_inverse=True)[1] + 1
    index = FmIndex(symbols)
    begin = np.cumsum(size + 1) - size - 1
    windows = size - window + 1
    segment = np.repeat(np.arange(len(size)), windows)
    position = np.arange(len(segment)) - (np.cumsum(windows) - windows)[segment]
    match, low, _ = index.search(symbols, begin[segment] + position + window, window)
    hit = match == window  # it occurs at least twice; the windows of an interval are equal
    segment, position, low = segment[hit], position[hit], low[hit]
    at_doc, at = doc[segment], start[segment].astype(np.int64) + position
    order = np.lexsort((at, at_doc, low))
    begins = np.concatenate([[True], np.diff(low[order]) != 0]) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(order) else order
    later = (at_doc[order] != at_doc[first]) | (at[order] != at[first])
    return segment[order[later]], position[order[later]]


def _searched(segment_words: DataFrame, window: int) -> DataFrame:
    """Step 3: the candidates' windows that start earlier in their shard."""

    def shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        words = np.concatenate([packed.unpack(b.column("words"), np.dtype("<u8")) for b in batches])
        doc = np.concatenate([b.column("doc_id").fill_null(_NULL_ID).to_numpy() for b in batches])
        tag, start = column("tag"), column("start")
        segment, position = repeated(words, column("n").astype(np.int64) + window - 1, doc, start, window)
        return _found(doc[segment], tag[segment], start[segment] + position, np.ones(len(segment)), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            if not len(buckets):
                continue
            cut = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(buckets)]):
                if bucket != buckets[a] and held:
                    yield shard(held)
                    held = []
                bucket = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield shard(held)

    return segment_words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """(doc_id, tag, start, n): runs of ``n`` windows that start earlier elsewhere, of documents (doc_id, tag, text)."""
    if not buckets:
        text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = packed.buckets(text_bytes // RECORD_BYTES)
    found = stored(_candidates(_records(docs, window, gram, buckets), hot), "found")
    wanted = found.where("hot is not null")
    words = wanted.agg(F.sum(F.when(F.col("hot"), F.col("n") * window).otherwise(F.col("n") + window - 1))).first()[0] or 0
    shards = max(8, words // shard_words)
    segment_words = _segment_words(_with_spans(docs, wanted, "inner"), window, gram, shards)
    searched = _searched(segment_words, window)
    return found.where("hot is null").unionByName(stored(searched, "searched"))


def _covered(spans: pa.Array, first: np.ndarray, window: int) -> np.ndarray:
    """Which words of a batch lie in reported windows."""
    edge = np.zeros(first[-1] + 1, np.int64)
    own = spans.flatten()
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
    begin = first[row] + own.field("start").to_numpy(zero_copy_only=False)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + own.field("n").to_numpy(zero_copy_only=False) + window - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document, and on demand the kept words joined by blanks as ``kept``."""
    named = _named(docs, id_col, text_col)
    found = repeated_windows(named, window, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            data, starts, ends, _, first = _words(batch)
            removed = _covered(batch.column("spans"), first, window)
            row, kept = T.row_of(first), np.flatnonzero(~removed)
            # a kept word keeps the byte before it as a blank, if it isn't the document's first
            follows = np.zeros(len(kept), bool)
            follows[1:] = row[kept[1:]] == row[kept[:-1]]
            out = data.copy()
            out[starts[kept[follows]] - 1] = 32
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[kept] - follows] += 1
            edge[ends[kept]] -= 1
            mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
            size = np.bincount(row[kept], ends[kept] - starts[kept] + follows, batch.num_rows).astype(np.int64)
            text, stop = out[mask].tobytes(), np.cumsum(size)
            parts = [text[a:b] for a, b in zip((stop - size).tolist(), stop.tolist())]
            count = np.diff(first)
            columns = [batch.column("doc_id"), pa.array(count), pa.array(count - np.bincount(row[kept], minlength=batch.num_rows)), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch([*columns, pa.array([p.decode() for p in parts])] if with_text else columns, [*names, "kept"] if with_text else names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return _with_spans(named, found, "left").mapInArrow(run, schema)
