"""Linking sets of high Jaccard similarity inside groups of candidates, without comparing all pairs of texts of a group.

Every group of candidates has a pivot p, and each member x is compared with it: that
may link the two, and gives x's delta D(x), the elements in which x and p differ. For
two members, |x ^ y| = |D(x) ^ D(y)|. Where a pivot's members fall into several
components afterwards, their deltas come together, which tell all other links: a
delta is small for near copies, and the elements that two of them share are counted
from the lists of who has an element. A task takes such a group of up to ``MEMBERS``
members and ``DELTA_BYTES``.

In a larger group the deltas find candidates first. Two members of which none links
with the pivot, or one only, can link, with at most H differing elements, only if
| |D(x)| - |D(y)| | <= H, and their deltas then have c = ceil((|D(x)| + |D(y)| - H) / 2)
elements in common at least. So they share one among the first |D| - c + 1 of each, in
any common order; a member that links with the pivot needs few of them, as the
other's delta is the longer. The order puts first what few deltas will hold: rare
elements that the pivot lacks, then common ones that only it has. Members that share
such an element are the candidates of the next level: pairs in groups of few, a
pivot of their own in others. Nothing is done for groups whose members lie in one component
already. The last level compares all that is left pair by pair, so the components are
those of all links inside groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counters, packed
from . import textops as T
from .components import components
from .scratch import small, stored

#: What a task takes of a group's deltas.
MEMBERS, DELTA_BYTES = 2048, 1 << 24
#: Members of a group that is compared pair by pair in larger groups, at most; and levels before everything is.
FEW, LEVELS = 12, 6

_DELTA = np.dtype([("key", "<u8"), ("order", "<i4"), ("node", "<i8"), ("component", "<i8"), ("n", "<i4"), ("rank", "<i4")])
_PAIRS = "x bigint, p bigint, star boolean"


def packed_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(elements, cut) of sets stored as sorted 64-bit values: row i has elements[cut[i]:cut[i + 1]]."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.uint64), (offsets - offsets[0]) // 8


def pair_batch(x: np.ndarray, p: np.ndarray, star: bool) -> pa.RecordBatch:
    """Each pair of different nodes once."""
    keep = x != p
    pairs = np.unique(np.stack([x[keep], p[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    return pa.record_batch(
        [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(np.full(len(pairs), star))], ["x", "p", "star"]
    )


def first_pairs(chunks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(x, p, star): the nodes of a bucket's records (key, order, node) with the pivots of the groups that they are in."""
    for x, p, star in packed.meetings(chunks, 1, packed.no_pairs):
        yield pair_batch(x, p, star)


def compared(pairs: DataFrame, items: DataFrame, read: Callable, popularity, num: int, den: int) -> DataFrame:
    """Compare the sets of pairs (x, p, star, k, deep): linked, the sizes n and m, d (differing elements) and delta are added.

    ``items`` has (node, content), which ``read`` turns into sets. Where ``deep`` holds, ``delta``
    has x's delta to p in the order of the module's docstring. ``popularity`` is the broadcast
    table of :mod:`.counters`.
    """

    def ordered(only_x: np.ndarray, only_y: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The delta in an order that depends on the pivot y alone."""
        levels = popularity.value
        usual = np.median(levels[counters.place(y)]) - 16 if len(y) else 0  # a quarter of y's usual count
        delta = np.concatenate([only_x, only_y])
        level = levels[counters.place(delta)].astype(np.int64)
        of_x = np.arange(len(delta)) < len(only_x)
        kind = np.where(of_x, 2 * (level >= usual), np.where(level >= usual, 1, 2))
        return delta[np.lexsort((delta, np.where(kind == 1, -level, level), kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                (xs, x_cut), (ys, y_cut) = read(batch.column("own")), read(batch.column("other"))
                linked, differing, deltas = [], [], []
                for i, deep in enumerate(batch.column("deep").to_pylist()):
                    x, y = xs[x_cut[i] : x_cut[i + 1]], ys[y_cut[i] : y_cut[i + 1]]
                    at = np.searchsorted(y, x)
                    in_y = y[np.minimum(at, len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
                    n, m, common = len(x), len(y), int(in_y.sum())
                    links = common > 0 and den * common >= num * (n + m - common)
                    d = n + m - 2 * common
                    linked.append(links)
                    differing.append(d)
                    delta = None
                    if deep:
                        lacking = np.ones(m, bool)
                        lacking[at[in_y]] = False
                        delta = ordered(x[~in_y], y[lacking], y).tobytes()
                    deltas.append(delta)
                yield pa.record_batch(
                    [
                        *(batch.column(c) for c in ("x", "p", "star", "k")),
                        pa.array(linked, pa.bool_()),
                        pa.array(np.diff(x_cut).astype(np.int32)),
                        pa.array(np.diff(y_cut).astype(np.int32)),
                        pa.array(differing, pa.int32()),
                        pa.array(deltas, pa.binary()),
                    ],
                    ["x", "p", "star", "k", "linked", "n", "m", "d", "delta"],
                )

    x = items.select(F.col("node").alias("x"), F.col("content").alias("own"))
    p = items.select(F.col("node").alias("p"), F.col("content").alias("other"))
    joined = pairs.join(x, "x").join(p, "p").select("x", "p", "star", "k", "deep", "own", "other")
    return joined.mapInArrow(run, f"{_PAIRS}, k bigint, linked boolean, n int, m int, d int, delta binary")


def _by_deltas(rows: DataFrame, count: int, num: int, den: int, few: int) -> DataFrame:
    """(x, p, star): candidates among the members (x, p, component, linked, n, m, d, delta) of large groups."""
    n_buckets = packed.buckets(40 * count)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, cut = packed_sets(batch.column("delta"))
            n, m, d = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m", "d"))
            most = (den - num) * (n + n * den // num) // (den + num)
            # a partner's delta is longer than what links with the pivot
            shorter = (d + np.maximum(0, (den - num) * (n - m) // (den + num)) + 2) // 2
            most = np.where(batch.column("linked").to_numpy(zero_copy_only=False), np.minimum(most, shorter), most)
            row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            early = np.arange(len(row)) - cut[row] <= most[row]
            elements, row = elements[early], row[early]
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            out = np.zeros(len(row), _DELTA)
            out["key"] = T.mix(elements ^ T.mix(batch.column("p").to_numpy().view(np.uint64))[row])
            for name, column in (("order", "d"), ("node", "x"), ("component", "component"), ("n", "n")):
                out[name] = batch.column(column).to_numpy()[row]
            out["rank"] = np.arange(len(row)) - cut[row]
            yield packed.rows(packed.deal(out["key"], n_buckets), out)

    def of_few(records: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = packed.all_pairs(group)
        a, b = records[i], records[j]
        most = (den - num) * (a["n"].astype(np.int64) + b["n"]) // (den + num)
        apart = a["order"].astype(np.int64) - b["order"]
        wanted = (a["component"] != b["component"]) & (2 * a["rank"] <= most + apart) & (2 * b["rank"] <= most - apart)
        x, p = a["node"][wanted], b["node"][wanted]
        return np.maximum(x, p), np.minimum(x, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def several(records: np.ndarray) -> np.ndarray:
            """Without the groups whose members lie in one component."""
            records = records[np.argsort(records["key"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]]))
            size = np.diff(np.append(first, len(records)))
            mixed = np.minimum.reduceat(records["component"], first) != np.maximum.reduceat(records["component"], first)
            return records[np.repeat(mixed, size)]

        for _, pieces in packed.by_bucket(batches):
            chunks = (packed.unpack(column, _DELTA) for _, column in pieces)
            held = []
            for chunk in chunks:
                held.append(chunk)
                if sum(map(len, held)) > 1 << 20:
                    break
            else:
                held = [several(np.concatenate(held))]
            for x, p, star in packed.meetings(itertools.chain(held, chunks), few, of_few):
                yield pair_batch(x, p, star)

    columns = rows.select("x", "p", "component", "linked", "n", "m", "d", "delta")
    return packed.exchanged(columns.mapInArrow(index, packed.SCHEMA)).mapInArrow(run, _PAIRS)


def _shared(elements: np.ndarray, cut: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """len(rest) x members: how many elements each of ``rest`` has in common with each member."""
    k = len(cut) - 1
    out = np.zeros((len(rest), k), np.int32)
    place = np.full(k, -1)
    place[rest] = np.arange(len(rest))
    _, element, often = np.unique(elements, return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(k), np.diff(cut))
    order = np.argsort(element, kind="stable")
    element, member = element[order], member[order]
    usual = often > 32
    columns = np.cumsum(usual) - 1
    own = usual[element]
    for start in range(0, int(usual.sum()), 1024):
        part = own & (columns[element] >= start) & (columns[element] < start + 1024)
        has = np.zeros((k, 1024), np.float32)
        has[member[part], columns[element[part]] - start] = 1
        out += (has[rest] @ has.T).astype(np.int32)
    element, member = element[~own], member[~own]
    for start in range(0, len(element), 1 << 16):  # the elements that begin in a piece, at most 32 rows past it
        a, b = (int(np.searchsorted(element, element[x])) if x < len(element) else len(element) for x in (start, start + (1 << 16)))
        i, j = packed.all_pairs(element[a:b])
        i, j = member[a:b][i], member[a:b][j]
        for x, y in ((i, j), (j, i)):
            mine = place[x] >= 0
            np.add.at(out.reshape(-1), place[x[mine]] * k + y[mine], 1)
    return out


def group_links(component, n, d, elements, cut, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the components of a group's members, from their sizes and deltas to one pivot; as few as connect them."""
    codes, code = np.unique(component, return_inverse=True)
    rest = np.flatnonzero(code != np.argmax(np.bincount(code)))
    n, d = n.astype(np.int64), d.astype(np.int64)
    both = n[rest][:, None] + n
    common = (both - d[rest][:, None] - d) // 2 + _shared(elements, cut, rest)
    linked = (common > 0) & (den * common >= num * (both - common))
    label = np.arange(len(codes))
    while True:
        own = label[code]
        to_rest = np.where(linked, own, len(codes)).min(1, initial=len(codes))
        to_all = np.where(linked, own[rest][:, None], len(codes)).min(0, initial=len(codes))
        new = label.copy()
        np.minimum.at(new, code[rest], to_rest)
        np.minimum.at(new, code, to_all)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return [(int(codes[c]), int(codes[label[c]])) for c in moved]


def _inside(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between the members (x, p, component, n, d, delta) of each p, as few as connect the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            group = pa.Table.from_batches(held).combine_chunks()
            elements, cut = packed_sets(group.column("delta").chunk(0))
            component, n, d = (group.column(c).to_numpy() for c in ("component", "n", "d"))
            links = np.array(group_links(component, n, d, elements, cut, num, den), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

        for batch in batches:
            p = batch.column("p").to_numpy()
            cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for i, j in zip(cut[:-1], cut[1:]):
                if j > i:
                    if held and own != p[i]:
                        yield found(held)
                        held = []
                    own = p[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield found(held)

    columns = rows.select("p", "component", "n", "d", "delta")
    return columns.repartition("p").sortWithinPartitions("p").mapInArrow(run, "a bigint, b bigint")


def link(
    pairs: DataFrame,
    items: DataFrame,
    read: Callable,
    popularity,
    num: int,
    den: int,
    members: int = MEMBERS,
    delta_bytes: int = DELTA_BYTES,
    few: int = FEW,
    levels: int = LEVELS,
) -> DataFrame | None:
    """(node, component) of the nodes that link, directly or through others; None if nothing links.

    ``pairs`` has (x, p, star), each once: where ``star`` holds, p is a pivot of a group with x.
    The other parameters are those of :func:`compared`, and the limits of the module's docstring.
    """
    labels = None

    def connected(links: DataFrame) -> DataFrame | None:
        if links.isEmpty():
            return labels
        if labels is not None:
            links = links.unionByName(labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        return components(links, "a", "b")

    for level in range(levels + 2):  # the last only compares what the level before it found
        sizes = pairs.where("star").groupBy("p").agg(F.count("*").alias("k"))
        sized = pairs.join(sizes, "p", "left").withColumn("deep", F.col("star") & (F.col("k") > 1))
        done = stored(compared(sized, items, read, popularity, num, den), "compared")
        labels = connected(done.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
        group = done.where("star and k > 1")
        place = group.select("x", "p", F.length("delta").alias("size"))  # deltas stay where they are until the open groups are known
        if labels is None:
            place = place.withColumn("component", F.col("x"))
        else:
            place = place.join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        mixed = place.groupBy("p").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"), F.sum("size").alias("size")
        )
        fits = ((F.col("held") <= members) & (F.col("size") <= delta_bytes)).alias("fits")
        place = stored(place.drop("size").join(mixed.where("lo < hi").select("p", fits), "p"), "open")
        group = group.join(small(place, 40), ["x", "p"])
        labels = connected(stored(_inside(group.where("fits"), num, den), "inside"))
        count = place.where("not fits").count()
        large = group.where("not fits")
        if not count:
            break
        if level < levels:
            found = _by_deltas(large, count, num, den, few)
        else:
            one = large.select("p", "x", "n", "d", "component")
            two = one.select("p", *[F.col(c).alias(c + "2") for c in ("x", "n", "d", "component")])
            most = F.floor(F.lit(den - num) * (F.col("n") + F.col("n2")) / F.lit(den + num))
            near = (F.col("x2") < F.col("x")) & (F.col("component") != F.col("component2")) & (F.abs(F.col("d") - F.col("d2")) <= most)
            found = one.join(two, "p").where(near).select("x", F.col("x2").alias("p"), F.lit(False).alias("star"))
        pairs = stored(found.groupBy("x", "p").agg(F.max("star").alias("star")), "pairs")
        if pairs.isEmpty():
            break
    return labels
