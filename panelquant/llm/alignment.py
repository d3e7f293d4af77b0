"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Byte offsets where tokens of both tokenizers end cut a text's tokens into groups. The
parts of a text form a monoid: a :class:`Fragment` of a byte range is an open
prefix (tokens up to the first common end), closed groups, and an open suffix (tokens
after the last common end). Two neighbours compose by closing the left one's suffix
with the right one's prefix; composition is associative, so it doesn't matter where
a text is cut.

Texts of up to ``RANGE_BYTES`` are one fragment. Longer ones are cut into byte ranges
that are dealt over the cluster; a range is tokenized with the bytes around it up to
the next places where both tokenizers always cut, and owns the tokens that end in it.
The fragments of a text are then reduced as a tree, ``FAN`` neighbours at a time, a
level a job. Closed groups leave the tree as rows of their own, so its fragments stay
as small as their open ends, and the last step hashes a text's groups as they come.

Pairs are counted by documents in the whole corpus, and the counts joined back; the
count table is broadcast only while it is small.

Tokenizers run on the distinct chunks between such places, each once a worker as long
as it is kept.

Cases: null and empty texts, and texts that the tokenizers don't give back byte by
byte, have no tokens. Repeated rows each count. A stretch without a place to cut is
one range, however long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import small, stored

#: Bytes of a range of a long text, and neighbours that are composed at once.
RANGE_BYTES, FAN = 32 << 10, 16
#: Between places where both tokenizers cut, a range's border may lie in stretches of so many bytes.
CONTEXT_BYTES = 4 << 10
#: Distinct chunks that a Python worker keeps.
KEPT_CHUNKS = 400_000

_ASCII_LETTER, _ASCII_MARK, _ODD_LEAD = (np.zeros(256, bool) for _ in range(3))
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_ASCII_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "_|"]] = True
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # may begin white space outside ASCII

_DIGITS = np.zeros((1 << 16, 6), np.uint8)
_N_DIGITS = np.array([len(str(i)) for i in range(1 << 16)])
for _i in range(1 << 16):
    _DIGITS[_i, : _N_DIGITS[_i]] = np.frombuffer(str(_i).encode(), np.uint8)


_BLANK, _EMPTY = (pa.scalar(x, pa.large_string()) for x in (" ", ""))


def _spaced(text: pa.Array) -> pa.Array:
    """A blank before each text that isn't empty."""
    text = text.cast(pa.large_string())
    return pc.if_else(pc.equal(text, _EMPTY), _EMPTY, pc.binary_join_element_wise(_BLANK, text, _EMPTY))


def cuts(data: np.ndarray) -> np.ndarray:
    """Marks (one more than bytes) where both tokenizers cut whatever stands around.

    That is before a lone blank and around a lone line break between two visible
    characters, and between an ASCII letter and an ASCII mark: no piece or merge of
    either vocabulary spans such a place.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        ahead, here, behind = data[2:], data[1:-1], data[:-2]
        lone = ((here == 32) | (here == 10)) & (ahead > 32) & (behind > 32) & (ahead != 127) & (behind != 127) & ~_ODD_LEAD[ahead]
        wide = np.flatnonzero(lone & (behind >= 128))  # a character of several bytes, which may be white space
        two, three = data[np.maximum(wide - 1, 0)], data[np.maximum(wide - 2, 0)]
        lone[wide[(two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3))]] = False
        cut[1:-2] = lone
        cut[2:-1] |= lone & (here == 10)
    if len(data) > 1:
        cut[1:-1] |= _ASCII_LETTER[data[:-1]] & _ASCII_MARK[data[1:]]
    return cut


def grouped(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common ends, group of each A token, group of each B token); tokens after the last common end have its number plus one."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return common, np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)


def written(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``a1,a2|b1;`` for ``n`` closed groups, and where each group's end."""
    a_size, b_size = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a_last, b_last = np.cumsum(a_size), np.cumsum(b_size)
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + (b_last - b_size)[a_group]] = a
    ids[np.arange(len(b)) + a_last[b_group]] = b
    mark[a_last + b_last - b_size - 1] = ord("|")
    mark[a_last + b_last - 1] = ord(";")
    size = _N_DIGITS[ids]
    table = _DIGITS[ids]
    table[np.arange(len(ids)), size] = mark
    ends = np.cumsum(size + 1)
    return table[np.arange(6) <= size[:, None]], ends[a_last + b_last - 1]


def linked(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(A id << 16 | B id of every link, links of each group)."""
    a_size, b_size = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    count = a_size * b_size
    group = np.repeat(np.arange(n), count)
    within = np.arange(len(group)) - (np.cumsum(count) - count)[group]
    left = (np.cumsum(a_size) - a_size)[group] + within // np.maximum(b_size[group], 1)
    right = (np.cumsum(b_size) - b_size)[group] + within % np.maximum(b_size[group], 1)
    return a[left].astype(np.uint32) << np.uint32(16) | b[right].astype(np.uint32), count


class Tokenizers:
    """Both tokenizers, and the tokens, groups and links of the chunks met so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies write the other bytes from U+0100 on
        byte_of = {chr(i): i for i in plain} | {chr(256 + n): i for n, i in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.vocab_size())
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of more than 65536 tokens don't fit the pair codes")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        (self.a_break,) = self.a.encode("\n", add_special_tokens=False).ids
        self.b_break = self.b.encode("\n")[-1]
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.text: list[bytes] = []
        self.whole = _Grown(bool)
        self.groups = _Grown(np.int64)
        self.a_ids, self.b_ids, self.links = _Ragged(np.uint16), _Ragged(np.uint16), _Ragged(np.uint32)

    def _split(self, ids: np.ndarray, line_break: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of lines, each of which starts with a line break."""
        breaks = np.flatnonzero(ids == line_break)
        return ids[ids != line_break], np.diff(np.append(breaks, len(ids))) - 1

    def _encoded(self, chunks: list[str], lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, sizes, B ids, sizes) of chunks; ``lines`` marks those without white space but for a leading blank, encoded many at a time."""
        parts: list[tuple] = []
        at = np.flatnonzero(lines)
        for k in range(0, len(at), 4096):
            text = "\n" + "\n".join(chunks[i] for i in at[k : k + 4096].tolist())
            a = self._split(np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), self.a_break)
            b = np.array(self.b.encode(text, num_threads=1), np.int64)
            parts.append((*a, *self._split(b[np.flatnonzero(b == self.b_break)[0] :], self.b_break)))
        odd = [chunks[i] for i in np.flatnonzero(~lines).tolist()]
        if odd:
            both = [e.ids for e in self.a.encode_batch(odd, add_special_tokens=False)], [x[x.index(self.b_break) + 1 :] for x in self.b.encode(["\n" + c for c in odd], num_threads=1)]
            sizes = [np.array([len(x) for x in each], np.int64) for each in both]
            flat = [np.fromiter(chain.from_iterable(each), np.int64, int(n.sum())) for each, n in zip(both, sizes)]
            parts.append((flat[0], sizes[0], flat[1], sizes[1]))
        order = np.argsort(np.concatenate([at, np.flatnonzero(~lines)]), kind="stable")
        ids_a, size_a, ids_b, size_b = (np.concatenate([p[i] for p in parts]) for i in range(4))
        return *_reordered(ids_a, size_a, order), *_reordered(ids_b, size_b, order)

    def _add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        odd = np.concatenate([[0], np.cumsum((data <= 32) | (data == 127) | _ODD_LEAD[data] | (data == 0x85) | (data == 0xA0))])
        lead = starts + (data[starts] == 32)
        lines = (odd[ends] == odd[lead]) & (ends > lead)
        raw = data.tobytes()
        source = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        a, a_size, b, b_size = self._encoded([x.decode() for x in source], lines)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        joined_a = b"".join([a_bytes[i] for i in a.tolist()])
        joined_b = b"".join([b_bytes[i] for i in b.tolist()])
        joined = b"".join(source)
        size = ends - starts
        if joined_a == joined and joined_b == joined:
            whole = np.ones(len(source), bool)
        else:  # look for the chunks that differ, which get no tokens
            at_a = np.concatenate([[0], np.cumsum(self.a_size[a])])[np.concatenate([[0], np.cumsum(a_size)])].tolist()
            at_b = np.concatenate([[0], np.cumsum(self.b_size[b])])[np.concatenate([[0], np.cumsum(b_size)])].tolist()
            same = zip(source, at_a, at_a[1:], at_b, at_b[1:])
            whole = np.array([joined_a[i:j] == x == joined_b[k:m] for x, i, j, k, m in same], bool)
            a, b = a[np.repeat(whole, a_size)], b[np.repeat(whole, b_size)]
            a_size, b_size, size = a_size * whole, b_size * whole, size * whole
        common, a_group, b_group = grouped(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        own = np.searchsorted(common, np.cumsum(size), "right")  # groups up to the end of each chunk
        n_groups = np.diff(own, prepend=0)
        text, text_ends = written(a, a_group, b, b_group, len(common))
        text, text_ends = text.tobytes(), np.concatenate([[0], text_ends])[np.concatenate([[0], own])].tolist()
        links, link_count = linked(a, a_group, b, b_group, len(common))
        link_ends = np.concatenate([[0], np.cumsum(link_count)])[own]
        n = len(self.text)
        self.text += [text[s:e] for s, e in zip(text_ends, text_ends[1:])]
        self.whole.add(whole)
        self.groups.add(n_groups)
        self.a_ids.add(a, a_size)
        self.b_ids.add(b, b_size)
        self.links.add(links, np.diff(link_ends, prepend=0))
        self.place.update(zip(keys.tolist(), range(n, n + len(keys))))

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each chunk, ``first``): row i has the chunks first[i] to first[i + 1]."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cut = cuts(data)
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        key, at, which = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > KEPT_CHUNKS:
            self.clear()
        new = np.flatnonzero([k not in self.place for k in key.tolist()])
        if len(new):
            self._add(key[new], data, starts[at[new]], ends[at[new]])
        slot = np.fromiter(map(self.place.__getitem__, key.tolist()), np.int64, len(key))[which]
        return slot, np.searchsorted(starts, offsets)


def _reordered(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], sizes


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Ragged:
    """Rows of values, one after the other."""

    def __init__(self, dtype):
        self.flat, self.ends = _Grown(dtype), _Grown(np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.ends.add(self.flat.n + np.cumsum(sizes))
        self.flat.add(values)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ends.data[rows] - np.where(rows > 0, self.ends.data[rows - 1], 0)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows, one row after the other, sizes)."""
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return self.flat.data[:0], sizes
        return self.flat.data[np.repeat(self.ends.data[rows] - ends, sizes) + np.arange(ends[-1])], sizes


_kept: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _kept:
        _kept[paths] = Tokenizers(*paths)
    return _kept[paths]


# Fragments ----------------------------------------------------------------------------------------------------


@dataclass
class Fragment:
    """Tokens of a byte range: before its first common end, and after its last; without one, all are in the prefix."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    cut: bool = False
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    #: Where the prefix would end as a group, and where the suffix begins.
    first: int = 0
    last: int = 0

    def then(self, other: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
        """Both ranges as one, and the group (its start, A ids, B ids) that this closes between them."""
        if not self.cut:
            prefix = (self.prefix[0] + other.prefix[0], self.prefix[1] + other.prefix[1])
            return Fragment(prefix, other.cut, other.suffix, other.first, other.last), None
        middle = (self.suffix[0] + other.prefix[0], self.suffix[1] + other.prefix[1])
        if not other.cut:
            return Fragment(self.prefix, True, middle, self.first, self.last), None
        return Fragment(self.prefix, True, other.suffix, self.first, other.last), (self.last, *middle)


def closed(groups: list[tuple[list[int], list[int]]]) -> tuple[bytes, np.ndarray]:
    """The text and the links of single groups."""
    text = b"".join(b",".join(b"%d" % x for x in a) + b"|" + b",".join(b"%d" % x for x in b) + b";" for a, b in groups)
    links = [np.repeat(np.array(a, np.uint32), len(b)) << np.uint32(16) | np.tile(np.array(b, np.uint32), len(a)) for a, b in groups]
    return text, np.concatenate([np.zeros(0, np.uint32), *links])


_RANGE = "row bigint, seq int, base bigint, low bigint, high bigint, text string"
_OPEN = "cut boolean, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, first bigint, last bigint"
#: kind 0: a fragment's open ends; kind 1: closed groups that begin at byte ``at``.
_TREE = f"kind int, row bigint, seq int, at bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, whole boolean, groups binary, pairs array<int>, times array<int>, {_OPEN}"
_TREE_NAMES = [c.split()[0] for c in _TREE.split(", ")]


def _ranges(texts: DataFrame, size: int, context: int) -> DataFrame:
    """Long texts (row, text) cut into byte ranges (base + low, base + high] with the bytes around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text", 1):
            data, _ = T.utf8(_spaced(batch.column("text")))
            place = np.append(np.flatnonzero(cuts(data)), len(data))
            border, out = [0], []
            while border[-1] < len(data):
                at = min(border[-1] + size, len(data))
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1  # not inside a character
                k = int(np.searchsorted(place, at))
                if at < len(data) and place[k] - (place[k - 1] if k else 0) > context:
                    at = int(place[k])
                border.append(at)
            raw = data.tobytes()
            for seq, (low, high) in enumerate(zip(border, border[1:])):
                k = int(np.searchsorted(place, low, "right")) - 1
                base = int(place[k]) if k >= 0 else 0
                end = int(place[np.searchsorted(place, high)])
                out.append((batch.column("row")[0].as_py(), seq, base, low - base, high - base, raw[base:end].decode()))
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[k : k + 64])], [c.split()[0] for c in _RANGE.split(", ")]).cast(_RANGE_ARROW)

    return texts.mapInArrow(run, _RANGE)


_RANGE_ARROW = pa.schema([("row", pa.int64()), ("seq", pa.int32()), ("base", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("text", pa.string())])
_INTS = pa.list_(pa.int32())
_TREE_ARROW = pa.schema(
    [("kind", pa.int32()), ("row", pa.int64()), ("seq", pa.int32())]
    + [(c, pa.int64()) for c in ("at", "n_a", "n_b", "n_groups", "n_links")]
    + [("whole", pa.bool_()), ("groups", pa.binary()), ("pairs", _INTS), ("times", _INTS), ("cut", pa.bool_())]
    + [(c, _INTS) for c in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")]
    + [("first", pa.int64()), ("last", pa.int64())]
)


def _counted(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair, times = np.unique(links, return_counts=True)
    return pair.view(np.int32), times.astype(np.int32)


def _open_row(row: int, seq: int, f: Fragment) -> dict:
    ends = {"prefix_a": f.prefix[0], "prefix_b": f.prefix[1], "suffix_a": f.suffix[0], "suffix_b": f.suffix[1]}
    return {"kind": 0, "row": row, "seq": seq, "cut": f.cut, "first": f.first, "last": f.last, **ends}


def _closed_row(row: int, at: int, groups: list[tuple[list[int], list[int]]], **more) -> dict:
    text, links = closed(groups)
    pairs, times = _counted(links)
    counts = {"n_a": sum(len(a) for a, _ in groups), "n_b": sum(len(b) for _, b in groups), "n_groups": len(groups), "n_links": len(links)}
    return {"kind": 1, "row": row, "at": at, "whole": True, "groups": text, "pairs": pairs, "times": times, **counts, **more}


def _leaf(found: Tokenizers, part: dict) -> Iterator[dict]:
    """A range's fragment and its closed groups."""
    row, low, high, base = part["row"], part["low"], part["high"], part["base"]
    data = np.frombuffer(part["text"].encode(), np.uint8)
    slot, _ = found.slots(data, np.array([0, len(data)]))
    whole = bool(found.whole.data[slot].all())
    if not whole:
        yield _closed_row(row, base + low, [], whole=False)
        yield _open_row(row, part["seq"], Fragment())
        return
    sides = []
    for ids, sizes in ((found.a_ids, found.a_size), (found.b_ids, found.b_size)):
        own = ids.take(slot)[0].astype(np.int64)
        ends = np.cumsum(sizes[own])
        inside = (ends > low) & (ends <= high)
        sides.append((own[inside], ends[inside]))
    (a, a_ends), (b, b_ends) = sides
    common, a_group, b_group = grouped(a_ends, b_ends)
    n = len(common)
    take = lambda group, k: [x.tolist() for x in (a[a_group == group], b[b_group == group])] if k else [[], []]
    if not n:
        yield _open_row(row, part["seq"], Fragment((a.tolist(), b.tolist())))
        return
    yield _open_row(row, part["seq"], Fragment(tuple(take(0, 1)), True, tuple(take(n, 1)), base + int(common[0]), base + int(common[-1])))
    in_a, in_b = (a_group > 0) & (a_group < n), (b_group > 0) & (b_group < n)
    if n > 1:
        own = (a[in_a], a_group[in_a] - 1, b[in_b], b_group[in_b] - 1, n - 1)
        links, _ = linked(*own)
        pairs, times = _counted(links)
        yield {"kind": 1, "row": row, "at": base + int(common[0]), "n_a": int(in_a.sum()), "n_b": int(in_b.sum()), "n_groups": n - 1,
               "n_links": len(links), "whole": True, "groups": written(*own)[0].tobytes(), "pairs": pairs, "times": times}


def _rows(dicts: Iterator[dict], each: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for d in dicts:
        held.append(d)
        if len(held) == each:
            yield pa.RecordBatch.from_pylist(held, _TREE_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _TREE_ARROW)


def _leaves(ranges: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _tokenizers(paths)
        yield from _rows(d for batch in batches for part in batch.to_pylist() for d in _leaf(found, part))

    return ranges.repartition("row", "seq").mapInArrow(run, _TREE)


def _reduced(tree: DataFrame, fan: int, last: bool) -> DataFrame:
    """One level: ``fan`` neighbours become one; at the last level, the text's first group closes as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def composed() -> Iterator[dict]:
            key, whole = None, Fragment()
            for batch in batches:
                for r in batch.to_pylist():
                    own = (r["row"], r["seq"] // fan)
                    part = Fragment((r["prefix_a"], r["prefix_b"]), r["cut"], (r["suffix_a"], r["suffix_b"]), r["first"], r["last"])
                    if own != key:
                        if key is not None:
                            yield from finished(key, whole)
                        key, whole = own, part
                        continue
                    whole, group = whole.then(part)
                    if group:
                        yield _closed_row(key[0], group[0], [group[1:]])
            if key is not None:
                yield from finished(key, whole)

        def finished(key: tuple[int, int], whole: Fragment) -> Iterator[dict]:
            if not last:
                yield _open_row(*key, whole)
            elif whole.cut:
                yield _closed_row(key[0], 0, [whole.prefix])

        return _rows(composed())

    parent = F.floor(F.col("seq") / fan)
    dealt = tree.where("kind = 0").repartition("row", parent).sortWithinPartitions("row", "seq")
    return dealt.mapInArrow(run, _TREE)


def _long(texts: DataFrame, paths: tuple[str, str], size: int, context: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (row, text): (row, n_a, n_b, n_groups, n_links, groups_sha256), and (row, pair, times)."""
    ranges = stored(_ranges(texts, size, context), "ranges")
    most = ranges.agg(F.max("seq")).first()[0]
    levels = [stored(_leaves(ranges, paths), "leaves")]
    while most is not None:
        most //= fan
        levels.append(stored(_reduced(levels[-1], fan, most == 0), "tree"))
        if not most:
            break
    groups = levels[0].where("kind = 1")
    for level in levels[1:]:
        groups = groups.unionByName(level.where("kind = 1"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            key, whole, sums, digest, held = None, True, None, None, b""
            for batch in batches:
                for r in batch.to_pylist():
                    if r["row"] != key:
                        if whole and key is not None:
                            digest.update(held[:-1])
                            yield {"row": key, **sums, "groups_sha256": digest.hexdigest()}
                        key, whole, sums, digest, held = r["row"], True, dict.fromkeys(_COUNTS, 0), hashlib.sha256(), b""
                    whole &= r["whole"]
                    for c in _COUNTS:
                        sums[c] += r[c]
                    digest.update(held)
                    held = r["groups"]
            if whole and key is not None:
                digest.update(held[:-1])
                yield {"row": key, **sums, "groups_sha256": digest.hexdigest()}

        for d in rows():
            yield pa.RecordBatch.from_pylist([d], _DIGEST_ARROW)

    dealt = groups.select("row", "at", "whole", *_COUNTS, "groups").repartition("row").sortWithinPartitions("row", "at")
    digests = stored(dealt.mapInArrow(run, "row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"), "digests")
    pairs = groups.select("row", F.inline(F.arrays_zip("pairs", "times"))).groupBy("row", F.col("pairs").alias("pair")).agg(F.sum("times").alias("times"))
    return digests, stored(pairs.join(digests.select("row"), "row", "left_semi"), "links")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_DIGEST_ARROW = pa.schema([("row", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string())])
_SHORT = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>"


def _short(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Texts (row, doc_id, text) that are one fragment each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _tokenizers(paths)
        for batch in T.blocks(batches, "text"):
            data, offsets = T.utf8(_spaced(batch.column("text")))
            slot, first = found.slots(data, offsets)
            chunks = np.diff(first)
            row = np.repeat(np.arange(batch.num_rows), chunks)
            broken = np.unique(row[~found.whole.data[slot]])
            if len(broken):
                keep = ~np.isin(row, broken)
                slot, row = slot[keep], row[keep]
                first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            total = lambda each: np.bincount(row, each[slot] if isinstance(each, np.ndarray) else each.sizes(slot), batch.num_rows).astype(np.int64)
            written_as, slots, digest = found.text, slot.tolist(), []
            for s, e in zip(first.tolist(), first[1:].tolist()):
                digest.append(hashlib.sha256(b"".join([written_as[k] for k in slots[s:e]])[:-1]).hexdigest() if e > s else "")
            n = [total(x) for x in (found.a_ids, found.b_ids, found.groups.data, found.links)]
            key, times = np.unique(row << 32 | slot, return_counts=True)
            links, sizes = found.links.take(key & 0xFFFFFFFF)
            key = np.repeat(key >> 32, sizes) << 32 | links.astype(np.int64)
            order = np.argsort(key)
            key, times = key[order], np.repeat(times, sizes)[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.add.reduceat(times, starts) if len(starts) else times
            ends = pa.array(np.searchsorted(key[starts] >> 32, np.arange(batch.num_rows + 1)), pa.int32())
            pairs = pa.ListArray.from_arrays(ends, pa.array((key[starts] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))
            lists = [pairs, pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *map(pa.array, n), pa.array(digest), *lists], [c.split()[0] for c in _SHORT.split(", ")])

    return texts.mapInArrow(run, _SHORT)


def align_documents(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = RANGE_BYTES,
    context_bytes: int = CONTEXT_BYTES,
    fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) of every document, and its links (row, pair, times).

    ``row`` tells documents apart; ``pair`` is the A id << 16 | the B id, as a signed number of 32 bits.
    """
    paths = (a_path, b_path)
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text")
    # both scans number their rows; even numbers are texts of one fragment, odd ones longer texts
    short = stored(_short(named.where(size <= range_bytes).withColumn("row", 2 * F.col("row")), paths), "short")
    long = stored(named.where(size > range_bytes).withColumn("row", 2 * F.col("row") + 1), "long")
    digests, long_links = _long(long.select("row", "text"), paths, range_bytes, context_bytes, fan)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS]
    found = stored(long.select("row", "doc_id").join(digests, "row", "left"), "named").select("row", "doc_id", *counts, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    short_links = short.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    return short.select(found.columns).unionByName(found), short_links.unionByName(long_links)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n_docs, best): how many documents link a pair, and whether no pair of its A id is in more."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n_docs"))
    of_a = Window.partitionBy(F.shiftrightunsigned("pair", 16))  # at most as many pairs as B has tokens
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def digest(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """The contract's columns, with the corpus-wide counts joined back."""
    found, links = align_documents(docs, a_path, b_path, **options)
    counts = small(stored(pair_counts(links), "pairs"), 48)
    scored = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return found.join(scored, "row", "left").select("doc_id", *map(zero, [*_COUNTS, "n_best", "count_sum"]), "groups_sha256")
