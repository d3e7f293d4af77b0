"""N-gram Jaccard join: exact set-similarity classes by universe-partition pigeonhole.

A document's set holds the hashes of its distinct word shingles. Sets are dealt
to size bands; each band cuts the universe of shingles into segments by hash, and
a set is indexed by the hash of its subset in a segment. Two sets of a band's
sizes that link differ in at most H shingles. Segments come in two kinds: in a
``near`` segment subsets meet that differ in one shingle at most, through
one-deletion neighbourhoods, so missing each other there uses up two differences;
in an ``exact`` segment equal subsets meet, and missing uses up one. A set may
leave out its most expensive exact segments: if all sets order their subsets by
one common order, it is enough that each indexes its first H + 1 - 2 * near exact
ones. The order is by cost: the count, over the whole corpus, of a subset's rarest
shingle, from a table of counters of fixed size. :func:`allocation` chooses the
numbers of segments for each band by estimated cost. Any choice is exact; costs
only decide how many candidates there are. Candidates are verified on whole sets.

Equal sets fold into one representative. :mod:`.linking` compares the sets that share
a signature, by way of pivots and not in all pairs.

Cases: a null or empty text has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle; repeated rows fold together; rows that
share an id count as linked; a row without id gets a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counters, packed
from . import textops as T
from .linking import first_pairs, link, packed_sets
from .scratch import small, stored

_SIGNED = np.dtype([("key", "<u8"), ("order", "<u2"), ("node", "<i8")])


def bands(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size ranges such that sets that link lie in the same or in neighbouring ranges."""
    out, low = [], 1
    while low <= largest:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


def difference(high: int, num: int, den: int) -> int:
    """The most elements in which linked sets differ if the smaller one has ``high`` elements."""
    return (den - num) * (high + high * den // num) // (den + num)


def allocation(size: int, most: int, rows: int) -> tuple[int, int, int]:
    """(exact, near, prefix) of a band of ``rows`` sets of about ``size`` elements that may differ in ``most``.

    ``prefix`` of the ``exact`` segments are indexed. A near segment costs as many
    signatures as its subset has elements, and one more, but strangers seldom
    meet there if it has many; the estimate weighs signatures against such meetings.
    """
    if not most:
        return 0, 0, 0  # only equal sets link, and those are one
    best = None
    for near in (0, most // 2 + 1):
        prefix = max(0, most + 1 - 2 * near)
        exact = max(prefix, round(size / 1.6)) if prefix else 0
        load = size / (exact + near)
        strange = prefix * 1e-3 ** (1 + load) + near * ((1 + load) * math.exp(-load)) ** 2
        cost = prefix + near * (1 + load) + 20 * rows * strange
        if best is None or cost < best[0]:
            best = (cost, exact, near, prefix)
    return best[1:]


def document_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row): the distinct shingles of each text."""
    return T.distinct(*T.shingles(*T.words(texts, T.BLANK), words))


def _set_hash(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return T.sums(T.mix(value), row, n), T.sums(T.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), row, n)


def _summary(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, h1, h2, cells): size and 128-bit hash of each document's set; and each task's counters, with n below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "h1", "h2", "cells"]
        counts = counters.Counts()
        for batch in T.blocks(batches, "text"):
            value, row = document_sets(batch.column("text"), words)
            k = batch.num_rows
            counts.add(value)
            h1, h2 = _set_hash(value, row, k)
            n = np.bincount(row, minlength=k).astype(np.int64)
            yield pa.record_batch([batch.column("id"), pa.array(n), T.array(h1), T.array(h2), pa.nulls(k, pa.binary())], names)
        for block, cells in counts.blocks():
            nulls = [pa.nulls(1, pa.int64()) for _ in range(3)]
            yield pa.record_batch([nulls[0], pa.array([-1 - block]), *nulls[1:], pa.array([cells], pa.binary())], names)

    return docs.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, cells binary")


def signatures(value, row, scheme, plan, popularity) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of rows with sets ``value`` under band ``scheme[row]`` (below 0: none)."""
    rows = len(scheme)
    exact, near, prefix = np.where(scheme[:, None] < 0, 0, plan[np.maximum(scheme, 0)]).T
    segments = exact + near
    base = np.concatenate([[0], np.cumsum(segments)])
    keep = segments[row] > 0
    value, row = value[keep], row[keep]
    spread = T.mix(value ^ np.uint64(0x51ED270B0F0F0F0F))
    segment = ((spread >> np.uint64(32)) * segments[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    slot = base[row] + segment
    weight = T.mix(spread + np.uint64(7))
    total = T.sums(weight, slot, base[-1])
    slot_row = np.repeat(np.arange(rows), segments)
    slot_segment = np.arange(base[-1]) - base[slot_row]
    is_near = slot_segment < near[slot_row]
    key = T.mix(scheme[slot_row].astype(np.uint64) << np.uint64(32) | slot_segment.astype(np.uint64))
    own = T.mix(total ^ key)
    # near segments: the subset, and the subset without each of its elements
    of_near = is_near[slot]
    out = [own[is_near], T.mix((total[slot[of_near]] - weight[of_near]) ^ key[slot[of_near]])]
    out_row = [slot_row[is_near], row[of_near]]
    # exact segments: the first ones in the common order
    cost = np.full(base[-1], 255, np.uint8)
    np.minimum.at(cost, slot, popularity[counters.place(value)])
    pool = np.flatnonzero(~is_near)
    order = pool[np.argsort(cost[pool].astype(np.uint64) << np.uint64(56) | own[pool] >> np.uint64(8))]
    small_int = np.uint16 if rows < 65536 else np.int64  # the first is sorted by digits
    order = order[np.argsort(slot_row[order].astype(small_int), kind="stable")]
    rank = np.arange(len(order)) - np.repeat(np.cumsum(exact) - exact, exact)
    order = order[rank < prefix[slot_row[order]]]
    return np.concatenate([*out, own[order]]), np.concatenate([*out_row, slot_row[order]])


class _Seen:
    """Sets that a task has met of late, in a table of fixed size."""

    def __init__(self, bits: int = 16):
        self.table = np.zeros((1 << bits, 2), np.uint64)
        self.bits = np.uint64(64 - bits)

    def new(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each set is not in the table and not among those before it in the arrays; all are put in."""
        both = np.stack([h1, h2], axis=1)
        place = (h1 >> self.bits).astype(np.int64)
        fresh = (self.table[place] != both).any(axis=1)
        self.table[place] = both
        _, first = np.unique(both, axis=0, return_index=True)
        once = np.zeros(len(h1), bool)
        once[first] = True
        return fresh & once


def _index(docs, words: int, sizes: list[tuple[int, int]], plan: np.ndarray, popularity, num: int, den: int, n_buckets: int) -> DataFrame:
    """Packed records (key: signature, order: pivots have low ones, node: id) of all sets, in their own band and in that below."""
    lows, highs = np.array([b[0] for b in sizes]), np.array([b[1] for b in sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = _Seen(), []
        for batch in T.blocks(batches, "text"):
            value, row = document_sets(batch.column("text"), words)
            k = batch.num_rows
            n = np.bincount(row, minlength=k)
            h1, h2 = _set_hash(value, row, k)
            fresh = (n > 0) & seen.new(h1, h2)
            keep = fresh[row]
            value, row = value[keep], row[keep]
            own_band = np.where(fresh, np.searchsorted(lows, n, "right") - 1, -1)
            below = np.where(own_band > 0, own_band - 1, -1)
            below = np.where(n * num <= highs[np.maximum(below, 0)] * den, below, -1)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            score = np.bincount(row, popularity.value[counters.place(value)], k) / np.maximum(n, 1)
            order = (65535 - 256 * score).astype(np.uint16)
            for scheme in (own_band, below):
                sig, at = signatures(value, row, scheme, plan, popularity.value)
                out = np.zeros(len(sig), _SIGNED)
                out["key"], out["order"], out["node"] = sig, order[at], ids[at]
                held.append(out)
            if sum(map(len, held)) > 1 << 19:
                out = np.concatenate(held)
                held = []
                yield packed.rows(packed.deal(out["key"], n_buckets), out)
        if held:
            out = np.concatenate(held)
            yield packed.rows(packed.deal(out["key"], n_buckets), out)

    return docs.mapInArrow(run, packed.SCHEMA)


def _meetings(index: DataFrame) -> DataFrame:
    """(x, p, star): every id with the pivots of the signatures that it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in packed.by_bucket(batches):
            yield from first_pairs(packed.unpack(column, _SIGNED) for _, column in pieces)

    return packed.exchanged(index).mapInArrow(run, "x bigint, p bigint, star boolean")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, content): the id, and the sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            value, row = document_sets(batch.column("text"), words)
            value = value[np.lexsort((value, row))]
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            content = [value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([batch.column("id"), pa.array(content, pa.binary())], ["node", "content"])

    return docs.mapInArrow(run, "node bigint, content binary")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """(id, n_shingles, component_id): documents link when ``den * |A & B| >= num * |A | B|``.

    The text is read three times (sizes; signatures; sets of candidates) and
    not shuffled, except for the sets of candidates, where they are too many to
    broadcast their ids. The shuffled index has about 0.4 records of 18 bytes a shingle.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    gathered = stored(_summary(docs, words), "summary")
    summary = gathered.where("n >= 0").drop("cells")
    classes = summary.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    member = summary.join(classes, ["h1", "h2", "n"], "left")
    largest, shingles = summary.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    labels = None
    if largest:
        sizes = bands(largest, num, den)
        lows = [low for low, _ in sizes]
        count = dict(
            summary.where("n > 0")
            .groupBy(F.floor(F.log2(F.col("n").cast("double")) * 2).alias("octave"))
            .count()
            .collect()
        )
        plan = np.array(
            [
                allocation(low, difference(high, num, den), count.get(math.floor(math.log2(low) * 2), 0) + 1)
                for low, high in sizes
            ],
            np.int64,
        )
        popularity = docs.sparkSession.sparkContext.broadcast(
            counters.merged(gathered.where("n < 0").select((-1 - F.col("n")).alias("block"), "cells"))
        )
        named = docs.where("id is not null")
        index = _index(named, words, sizes, plan, popularity, num, den, packed.buckets(shingles // 2))
        pairs = stored(_meetings(index).groupBy("x", "p").agg(F.max("star").alias("star")), "pairs")
        reps = member.where("rep is not null").select("id", "rep").distinct()
        others = stored(reps.where("id <> rep"), "copies")
        others = small(others, 24)
        for c in ("x", "p"):
            as_rep = others.select(F.col("id").alias(c), F.col("rep").alias("__rep"))
            pairs = pairs.join(as_rep, c, "left").withColumn(c, F.coalesce("__rep", c)).drop("__rep")
        pairs = stored(pairs.where("x <> p").groupBy("x", "p").agg(F.max("star").alias("star")), "pairs")
        wanted = stored(pairs.select(F.explode(F.array("x", "p")).alias("id")).distinct(), "wanted")
        sets = _sets(named.join(small(wanted, 16), "id", "left_semi"), words)
        if not summary.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
            sets = sets.dropDuplicates()  # else a row that repeats would be compared as often
        sets = stored(sets, "sets")
        labels = link(pairs, sets, packed_sets, popularity, num, den)
    if labels is None:
        out = member.withColumn("component", F.lit(None).cast("bigint"))
    else:
        out = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")
    )
