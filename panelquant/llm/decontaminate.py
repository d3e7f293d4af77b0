"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the corpus as shards, each the postings of a block of whole
documents: its terms in order, and for each term the sorted positions of its
occurrences. Searches run shard by shard: the query terms' lists are intersected
after subtracting each term's offset in the phrase, starting from the term that is
rarest in the shard, so that a few positions survive the first step. No posting
is shuffled. Query items are sent to the executors in blocks of bounded size.

Cases: null and empty texts have no words and are never hit; an item without
words has no windows; repeated documents and items are each searched; positions
never cross documents; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import stored

#: Text bytes of a shard (a longer document is a shard of its own).
SHARD_BYTES = 8 << 20
#: Characters of query items that are sent to the executors at once.
QUERY_CHARS = 8 << 20

INDEX = "shard string, doc_ids binary, doc_known binary, doc_starts binary, terms binary, term_starts binary, gaps binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the positional index of the lower-cased words; one row a shard, its arrays as little-endian binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ordinal, batch in enumerate(T.blocks(batches, "text", shard_bytes)):
            parts = [T.words(b.column("text"), T.NOT_ALNUM) for b in T.blocks([batch], "text")]
            word = np.concatenate([w for w, _ in parts])
            counts = np.concatenate([np.diff(first) for _, first in parts])
            starts = np.concatenate([[0], np.cumsum(counts)]).astype("<i4")
            order = np.argsort(word, kind="stable")
            word = word[order]
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            gaps = np.diff(order, prepend=0)
            gaps[begins] = order[begins]
            ids = batch.column("id")
            row = [
                f"{TaskContext.get().partitionId()}-{ordinal}",  # the rows are stored, so the name stays this block's own
                ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                starts.tobytes(),
                word[begins].astype("<u8").tobytes(),
                np.append(begins, len(word)).astype("<i4").tobytes(),
                gaps.astype("<i4").tobytes(),
            ]
            yield pa.record_batch([pa.array([x], pa.string() if k == 0 else pa.binary()) for k, x in enumerate(row)], [c.split()[0] for c in INDEX.split(", ")])

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return stored(named.mapInArrow(run, INDEX), "postings")


class Shard:
    """One shard's postings."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        self.known = np.frombuffer(row["doc_known"], bool)
        self.starts = np.frombuffer(row["doc_starts"], "<i4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.term_starts = np.frombuffer(row["term_starts"], "<i4").astype(np.int64)
        gaps = np.frombuffer(row["gaps"], "<i4").astype(np.int64)
        total = np.cumsum(gaps)
        before = np.concatenate([[0], total])[self.term_starts[:-1]]
        sizes = np.diff(self.term_starts)
        self.positions = total - np.repeat(before, sizes)
        self.keys = np.repeat(np.arange(len(sizes)), sizes) << 32 | self.positions  # sorted

    def slot(self, term: np.ndarray) -> np.ndarray:
        """The term's number in this shard, or -1."""
        if not len(self.terms):
            return np.full(term.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, at, -1)

    def has(self, slot: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = slot << 32 | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (position >= 0) & (self.keys[at] == key)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def phrases(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all exact occurrences of the phrases ``terms[i, :sizes[i]]``."""
        slots = self.slot(terms)
        offsets = np.arange(terms.shape[1])
        used = offsets < sizes[:, None]
        alive = np.flatnonzero(((slots >= 0) | ~used).all(1) & (sizes > 0))
        if not len(alive) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots, used = slots[alive], used[alive]
        frequency = np.where(used, (self.term_starts[1:] - self.term_starts[:-1])[slots], np.iinfo(np.int64).max)
        rarest = np.argsort(frequency, axis=1, kind="stable")
        here = np.arange(len(alive))
        first = slots[here, rarest[:, 0]]
        count = frequency[here, rarest[:, 0]]
        phrase = np.repeat(here, count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        position = self.positions[np.repeat(self.term_starts[first], count) + within] - np.repeat(rarest[:, 0], count)
        for k in range(1, terms.shape[1]):
            offset = rarest[phrase, k]
            keep = ~used[phrase, offset]
            keep |= self.has(slots[phrase, offset], position + offset)
            phrase, position = phrase[keep], position[keep]
        size = sizes[alive][phrase]
        inside = position >= 0
        inside[inside] = self.doc(position[inside]) == self.doc(position[inside] + size[inside] - 1)
        return alive[phrase[inside]], position[inside]

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Start and end positions of the shortest stretches of at most ``width`` words with all terms."""
        slots = self.slot(np.unique(terms))
        if not len(slots) or (slots < 0).any():
            return np.zeros((0, 2), np.int64)
        lists = [self.positions[self.term_starts[s] : self.term_starts[s + 1]] for s in slots[np.argsort(np.diff(self.term_starts)[slots])]]
        begin = np.unique(np.concatenate(lists))
        end = begin
        for own in lists:
            at = np.searchsorted(own, begin)
            keep = at < len(own)
            begin, end, at = begin[keep], end[keep], at[keep]
            end = np.maximum(end, own[at])
            keep = end - begin < width
            begin, end = begin[keep], end[keep]
        same = self.doc(begin) == self.doc(end)
        begin, end = begin[same], end[same]
        shortest = np.append(end[1:] > end[:-1], True) if len(end) else np.zeros(0, bool)
        return np.stack([begin[shortest], end[shortest]], axis=1)


def _windows(items: Sequence[tuple], size: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(terms, sizes, item of each): the windows of the items' words; an item of fewer words is one window."""
    word, first = T.words(pa.array([t for _, t in items], pa.large_string()), T.NOT_ALNUM)
    terms, sizes, owner = [np.zeros((0, size), np.uint64)], [], []
    for i, (item, _) in enumerate(items):
        own = word[first[i] : first[i + 1]]
        if not len(own):
            continue
        if len(own) < size:
            own, k = np.concatenate([own, np.zeros(size - len(own), np.uint64)]), len(own)
        else:
            k = size
        rows = np.lib.stride_tricks.sliding_window_view(own, size)
        terms.append(rows)
        sizes += [k] * len(rows)
        owner += [item] * len(rows)
    return np.concatenate(terms), np.array(sizes, np.int64), owner


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``limit`` characters; the driver holds the first and one more at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // limit + 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def contamination(
    index: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "item_id",
    text_col: str = "text",
    query_chars: int = QUERY_CHARS,
) -> DataFrame:
    """(doc_id, n_words, hits, items) of every indexed document: positions of hit words, and ids of items with occurring windows."""

    def search(items: list[tuple]) -> DataFrame:
        terms, sizes, owner = _windows(items, window)
        names = sorted(set(owner), key=str)
        number = {x: i for i, x in enumerate(names)}
        item_of = np.array([number[x] for x in owner], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row)
                    phrase, position = shard.phrases(terms, sizes)
                    n = len(shard.ids)
                    cover = np.zeros(shard.starts[-1] + 1, np.int64)
                    np.add.at(cover, position, 1)
                    np.add.at(cover, position + sizes[phrase], -1)
                    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                    of_hit = shard.doc(hit)
                    pair = np.unique(shard.doc(position) * max(1, len(names)) + item_of[phrase])
                    of_pair = pair // max(1, len(names))
                    hits = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(of_hit, np.arange(n + 1)), pa.int32()), pa.array(hit - shard.starts[of_hit], pa.int32())
                    )
                    found = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(of_pair, np.arange(n + 1)), pa.int32()),
                        pa.array([names[i] for i in (pair % max(1, len(names))).tolist()], pa.string()),
                    )
                    yield pa.record_batch(
                        [
                            pa.array([row["shard"]] * n),
                            pa.array(np.arange(n), pa.int32()),
                            pa.array(shard.ids, mask=~shard.known),
                            pa.array(np.diff(shard.starts)),
                            hits,
                            found,
                        ],
                        ["shard", "ordinal", "doc_id", "n_words", "hits", "items"],
                    )

        return index.mapInArrow(
            run, "shard string, ordinal int, doc_id bigint, n_words bigint, hits array<int>, items array<string>"
        )

    blocks = _blocks(benchmark, id_col, text_col, query_chars)
    first = search(next(blocks))
    found = None
    for items in blocks:  # of later blocks, only the documents that they hit are kept
        more = stored(search(items).where(F.size("hits") > 0).select("shard", "ordinal", "hits", "items"), "found")
        found = more if found is None else found.unionByName(more)
    if found is None:
        return first.drop("shard", "ordinal")
    found = found.groupBy("shard", "ordinal").agg(
        F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items")
    )
    joined = first.join(found, ["shard", "ordinal"], "left")
    both = lambda a, b: F.array_sort(F.array_distinct(F.concat(a, F.coalesce(b, F.array().cast(first.schema[a].dataType)))))
    return joined.select("doc_id", "n_words", both("hits", F.col("more_hits")).alias("hits"), both("items", F.col("more_items")).alias("items"))


def proximity(index: DataFrame, query: Sequence[str], width: int) -> DataFrame:
    """(doc_id, start, end): the shortest stretches of at most ``width`` words that hold all words of ``query``."""
    terms, _ = T.words(pa.array([" ".join(query)]), T.NOT_ALNUM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                found = shard.near(terms, width)
                doc = shard.doc(found[:, 0])
                base = shard.starts[doc]
                yield pa.record_batch(
                    [pa.array(shard.ids[doc], mask=~shard.known[doc]), pa.array(found[:, 0] - base), pa.array(found[:, 1] - base)],
                    ["doc_id", "start", "end"],
                )

    return index.mapInArrow(run, "doc_id bigint, start bigint, end bigint")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`contamination`'s."""
    n_hit = F.size("hits").cast("bigint")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
