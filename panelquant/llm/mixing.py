"""Language-model scoring by online logistic context mixing.

A text (A-Z lower-cased) is a sequence of words and of the white space before each,
closed by an end. Each is a path of binary decisions in a code tree: frequent words
(met twice at least) and separators have a leaf, others take an escape and are spelled byte
by byte in a third tree. Every decision is predicted several times, from the counts that hashed contexts
left in tables: the tree node alone, and the node with the one, two and three words before
(for bytes: with two, three and five bytes before). The predictions are mixed in the logistic domain with weights that a gate selects, and an
adaptive probability map refines the result. The sum over all decisions is the
text's code length, and so its probability.

Trees and tables come from the whole training corpus. Each task goes through its rows
once: it predicts a block of texts from what it has counted so far, learns weights and
map online from the outcome, and counts the block; a word with a leaf is spelled too when a
task meets it first (and only then), since new words are spelled like those. Tasks send the cells that they
touched, keyed by blocks of the table, and the counts are summed; weights and map are
averaged by how often each was used. A task takes ``TASK_BYTES`` of text, so what
is gathered grows with the corpus; each table has as many cells as there are training bytes,
rounded up to a power of two, and at most ``2 ** TABLE_BITS``, so the merged
tables can be broadcast. Beyond that size unrelated contexts share cells. Scoring
changes nothing: given a model, a text's score doesn't depend on how texts are dealt to
tasks. A spelled byte's bits depend on it and the five before it alone, so a task works them out once;
equal ones of a block are learned as one that counts as many times. The weights depend a little on how the training rows are dealt.

Cases: a null or empty text is the end alone; without training rows every decision
is even; repeated rows get equal scores.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .labelled import held_out
from .scratch import stored

#: Words and separators with a leaf of their own.
HEAD_WORDS, HEAD_BLANKS = 1 << 17, 1 << 8
#: log2 of the largest table of a context, contexts besides the node alone, and cells that travel together (log2).
TABLE_BITS, CONTEXTS, BLOCK_BITS = 23, 3, 16
#: Text bytes whose decisions are held at once, and those of a counting task.
STEP_BYTES, TASK_BYTES = 1 << 20, 80 << 20
#: Symbols whose decisions are worked through at once, level by level, so that their columns stay in the processor's cache
#: (when learning, at first an 8th of the symbols before them, as little is counted), and spelled bytes, whose equals are one.
PIECE, LEAST, SPELLED = 1 << 15, 1 << 10, 1 << 20
PRIOR, SCALE = 0.4, 16.0
#: Kinds of symbols: white space, words, bytes of rare ones.
KINDS = BLANKS, WORDS, BYTES = 0, 1, 2
DEPTHS, STAGES, LEVELS = 8, 33, 27
END_WORD, END_BYTE = 0x6A09E667F3BCC908, 256

_SPACE = T.hashes(np.array([32], np.uint8), np.array([0]), np.array([1]))[0]
_SPREAD = np.uint64(int(T._ODD) * T._BASE % (1 << 64))
#: 128 times SCALE times the logarithm of each count.
_LOGS = np.rint(np.log(np.arange(1 << 16) + PRIOR) * (128 * SCALE)).astype(np.int16)
#: A cell is halved from 32768 on; so many decisions at once add no more than what is left up to 65535.
_FULL, _AT_ONCE = np.uint32(0x80008000), 1 << 15


def tree(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, length, base): each leaf's path in a Huffman tree of the weights, its bits from the highest of 64 on.

    Codes are canonical: at each depth leaves come before nodes, so a node's number is the bits that lead to it plus ``base`` of its depth.
    """
    order = np.argsort(weight, kind="stable").tolist()
    n = len(order)
    parent = [0] * (2 * n - 1)
    leaves, made = deque((float(weight[i]), i) for i in order), deque()
    for number in range(n, 2 * n - 1):
        total = 0.0
        for _ in range(2):
            source = leaves if leaves and (not made or leaves[0][0] <= made[0][0]) else made
            w, i = source.popleft()
            parent[i] = number
            total += w
        made.append((total, number))
    depth = np.zeros(2 * n - 1, np.int64)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    length = depth[:n]
    leaves_at = np.bincount(length).tolist()
    path, base, first, nodes, total = np.zeros(n, np.uint64), [], 0, 0, 1
    for d, many in enumerate(leaves_at):
        own = np.flatnonzero(length == d)
        if d:
            path[own] = (first + np.arange(len(own))).astype(np.uint64) << np.uint64(64 - d)
        first += many
        base.append(nodes - first)
        nodes, first, total = nodes + total - many, 2 * first, 2 * (total - many)
    return path, length, np.array(base, np.int64)


@dataclass
class Code:
    """The three trees, their leaves one after another: separators and escape, words and escape, bytes and end."""

    blanks: np.ndarray  # sorted hashes
    words: np.ndarray
    word_counts: np.ndarray
    word_leaf: np.ndarray  # among those of the words; the escape for words that were met once
    first: tuple[int, int, int]  # leaf
    path: np.ndarray  # of leaves, as :func:`tree` gives them
    length: np.ndarray
    base: tuple[np.ndarray, ...]  # of kinds
    nodes: int

    @classmethod
    def build(cls, blanks, blank_counts, blank_escape, words, word_counts, word_escape, byte_counts) -> Code:
        twice = (word_counts > 1) | (words == np.uint64(END_WORD))
        leaf = np.where(twice, np.cumsum(twice) - 1, twice.sum())
        parts = [np.append(blank_counts, blank_escape), np.append(word_counts[twice], word_escape), byte_counts + 0.5]
        path, length, base, nodes = [], [], [], 0
        for weight in parts:
            p, n, b = tree(weight)
            path.append(p)
            length.append(n)
            base.append(b + nodes)
            nodes += len(weight) - 1
        first = (0, len(parts[0]), len(parts[0]) + len(parts[1]))
        return cls(blanks, words, word_counts, leaf, first, np.concatenate(path), np.concatenate(length).astype(np.int16), tuple(base), nodes)

    @cached_property
    def start(self) -> np.ndarray:
        """Where each leaf's path begins in :attr:`node` and :attr:`bit`, which hold all paths one after another."""
        length = self.length.astype(np.int64)
        return np.cumsum(length) - length

    @cached_property
    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        node, bit = np.zeros(int(self.length.sum()), np.int64), np.zeros(int(self.length.sum()), np.int8)
        for kind, (a, b) in enumerate(itertools.pairwise([*self.first, len(self.length)])):
            for depth, base in enumerate(self.base[kind].tolist()):
                leaf = a + np.flatnonzero(self.length[a:b] > depth)
                taken = self.path[leaf] >> np.uint64(63 - depth)
                node[self.start[leaf] + depth], bit[self.start[leaf] + depth] = (taken >> np.uint64(1)).astype(np.int64) + base, taken & np.uint64(1)
        return node, bit

    @property
    def node(self) -> np.ndarray:
        return self._steps[0]

    @property
    def bit(self) -> np.ndarray:
        return self._steps[1]

    @cached_property
    def near(self) -> np.ndarray:
        """Where the words begin that start with each 18 bits."""
        return np.searchsorted(self.words, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))

    @staticmethod
    def _find(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(known, key)
        return at, known[np.minimum(at, len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)

    def blank_leaves(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, whether it is the escape) of hashed separators."""
        at, has = self._find(self.blanks, key)
        return np.where(has, at, len(self.blanks)), ~has

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of hashed words among the most frequent ones."""
        at, last = self.near[(key >> np.uint64(46)).astype(np.int64)], len(self.words) - 1
        if last < 0:
            return at, np.zeros(len(key), bool)
        word = self.words[np.minimum(at, last)]
        has, on = word == key, np.flatnonzero(word < key)
        while len(on):
            at[on] += 1
            on = on[at[on] <= last]
            word = self.words[at[on]]
            has[on[word == key[on]]] = True
            on = on[word < key[on]]
        return at, has

    def word_leaves(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, whether it is the escape) of words as :meth:`find` gives them."""
        at, has = found
        escape = self.first[BYTES] - self.first[WORDS] - 1
        leaf = np.where(has, np.append(self.word_leaf, 0)[np.where(has, at, 0)], escape)
        return leaf + self.first[WORDS], leaf == escape

    def counts(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is known) of the same."""
        at, has = found
        return np.append(self.word_counts, 0)[np.where(has, at, 0)], has


class Met:
    """The leaves that a task has met."""

    def __init__(self, code: Code):
        self.seen = np.zeros(len(code.length), bool)

    def new(self, leaf: np.ndarray) -> np.ndarray:
        """Whether each leaf is met for the first time, once a leaf."""
        unseen = np.flatnonzero(~self.seen[leaf])
        value, first = np.unique(leaf[unseen], return_index=True)
        fresh = np.zeros(len(leaf), bool)
        fresh[unseen[first]] = True
        self.seen[value] = True
        return fresh


class Spelt:
    """The costs of spelled bytes that a task has met of late, in a table of fixed size."""

    def __init__(self, bits: int = 20):
        self.key, self.cost, self.shift = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan), np.uint64(64 - bits)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (T.mix(key) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The cost of each, not a number where it isn't in the table."""
        place = self._place(key)
        return np.where(self.key[place] == key, self.cost[place], np.nan)

    def put(self, key: np.ndarray, cost: np.ndarray) -> None:
        place, which = np.unique(self._place(key), return_index=True)
        self.key[place], self.cost[place] = key[which], cost[which]


@dataclass
class Tokens:
    """All words of some texts and an end of each text."""

    data: np.ndarray
    word: np.ndarray  # hashes
    space: np.ndarray  # of the separators before them
    start: np.ndarray
    end: np.ndarray
    blank: np.ndarray  # where the separator starts
    row: np.ndarray
    place: np.ndarray  # in its text


def _tokens(texts: pa.Array) -> Tokens:
    data, offsets = T.utf8(texts)
    data = data | (data - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5)  # A-Z become a-z
    starts, ends, first = T.spans(data, offsets, T.BLANK)
    sums = T.hash_sums(data)
    n = len(texts)
    own = np.arange(len(starts)) + T.row_of(first)
    last = first[1:] + np.arange(n)
    begin = first[:-1] + np.arange(n)
    total = len(starts) + n
    token, start, end = np.empty(total, np.uint64), np.empty(total, np.int64), np.empty(total, np.int64)
    token[own], start[own], end[own] = T.hashes(data, starts, ends, sums), starts, ends
    token[last], start[last], end[last] = np.uint64(END_WORD), offsets[1:], offsets[1:]
    blank = np.empty(total, np.int64)
    blank[1:] = end[:-1]
    blank[begin] = offsets[:-1]
    space = np.full(total, _SPACE)
    other = np.flatnonzero((start - blank != 1) | (np.append(data, np.uint8(0))[blank] != 32))
    space[other] = T.hashes(data, blank[other], start[other], sums)
    row = np.repeat(np.arange(n), np.diff(first) + 1)
    return Tokens(data, token, space, start, end, blank, row, np.arange(total) - begin[row])


def _joined(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = T.mix(out * T._ODD + part)
    return out


def _byte_pairs(parts: int) -> np.ndarray:
    """:func:`_joined` up to the second of ``parts`` parts, by two bytes plus 1 (0 for none)."""
    value = np.arange(END_BYTE + 1, dtype=np.uint64)
    first = T.mix(np.full(1, parts, np.uint64) * T._ODD + value)
    return T.mix(first[:, None] * T._ODD + value).reshape(-1)


_BYTE_PAIRS = {parts: _byte_pairs(parts) for parts in (2, 3, 5)}


def _whole(code: Code, t: Tokens, found: tuple[np.ndarray, np.ndarray]):
    """(leaf, contexts x symbols) of separators and then of words, and which separators and which words are escapes."""
    padded = np.concatenate([np.zeros(3, np.uint64), t.word])
    back = [np.where(t.place >= k, padded[3 - k : 3 - k + len(t.word)], 0).astype(np.uint64) for k in (1, 2, 3)]
    before = np.where(t.place >= 1, np.concatenate([[np.uint64(0)], t.space[:-1]]), 0).astype(np.uint64)
    one, two, three = _joined(back[0]), _joined(back[0], back[1]), _joined(*back)
    blank_leaf, rare_blank = code.blank_leaves(t.space)
    word_leaf, rare_word = code.word_leaves(found)
    context = np.concatenate([np.stack([one, two, _joined(back[0], before)]), np.stack([one, two, three])], axis=1)
    return np.concatenate([blank_leaf, word_leaf]), context, rare_blank, rare_word


def _spelled(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte and the five before it in its run, run) of the bytes of the runs from ``a`` to ``b``, and an end of each; 9 bits a byte."""
    size = b - a + 1
    of = np.repeat(np.arange(len(a)), size)
    within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at = a[of] + within
    byte = np.where(at < b[of], np.append(data, 0)[np.minimum(at, len(data))], END_BYTE).astype(np.uint64)
    out = byte.copy()
    for k in range(1, 6):
        out[k:] |= np.where(within[k:] >= k, byte[:-k] + np.uint64(1), np.uint64(0)) << np.uint64(9 * k)
    return out, of


def _bytes(code: Code, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, contexts x symbols) of bytes as :func:`_spelled` gives them."""
    byte, *last = ((spelled >> np.uint64(9 * k) & np.uint64(511)).view(np.int64) for k in range(6))
    pair = last[0] * (END_BYTE + 1) + last[1]
    context = np.empty((CONTEXTS, len(byte)), np.uint64)
    for k, parts in enumerate((2, 3, 5)):
        out = _BYTE_PAIRS[parts][pair]
        for part in last[2:parts]:
            out = T.mix(out * T._ODD + part.view(np.uint64))
        context[k] = out
    return byte + code.first[BYTES], context


def symbols(code: Code, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, kind, row, contexts x symbols) of all symbols of some texts, kind by kind, none folded."""
    t = _tokens(texts)
    leaf, context, blank, word = _whole(code, t, code.find(t.word))
    spelled, of = _spelled(t.data, *_runs(t, blank, word))
    byte_leaf, byte_context = _bytes(code, spelled)
    kind = np.repeat(KINDS, [len(t.word), len(t.word), len(of)])
    row = np.concatenate([t.row, t.row, np.concatenate([t.row[blank], t.row[word]])[of]])
    return np.concatenate([leaf, byte_leaf]), kind, row, np.concatenate([context, byte_context], axis=1)


def _runs(t: Tokens, blank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the separators and the words that are spelled start and end."""
    return np.concatenate([t.blank[blank], t.start[word]]), np.concatenate([t.start[blank], t.end[word]])


def to_learn(code: Code, columns: Iterable[pa.Array], done: list[int] | None = None):
    """(kind, leaf, contexts x symbols, times) of pieces of a task's symbols; ``done``: how many of each kind it has learned before.

    Words with a leaf are spelled too when they are met first. Kinds share neither nodes nor weights, so spelled bytes
    wait for more of their kind, and equal ones are folded; ``times`` is None for other kinds.
    """
    met, done, waiting = Met(code), done or [0] * len(KINDS), []

    def size(kind: int, most: int) -> int:
        return min(max(done[kind] // 8, LEAST), most)

    def folded(spelled: np.ndarray):
        value, times = np.unique(spelled, return_counts=True)
        # none counts so often at once that a cell could overflow
        copies = -(-times // (_AT_ONCE // 2))
        place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        value, times, copies = (np.repeat(x, copies) for x in (value, times, copies))
        times = times * (place + 1) // copies - times * place // copies
        for a in range(0, len(value), PIECE):
            own = slice(a, a + PIECE)
            yield BYTES, *_bytes(code, value[own]), times[own]
        done[BYTES] += len(spelled)

    for texts in columns:
        t = _tokens(texts)
        leaf, context, blank, word = _whole(code, t, code.find(t.word))
        n = len(t.word)
        waiting.append(_spelled(t.data, *_runs(t, blank, word | (met.new(leaf[n:]) & (t.end > t.start))))[0])
        for kind in (BLANKS, WORDS):
            a = kind * n
            while a < (kind + 1) * n:
                own = slice(a, min((kind + 1) * n, a + size(kind, PIECE)))
                yield kind, leaf[own], context[:, own], None
                done[kind] += own.stop - a
                a = own.stop
        if sum(map(len, waiting)) >= size(BYTES, SPELLED):
            spelled, a = np.concatenate(waiting), 0
            while len(spelled) - a >= (most := size(BYTES, SPELLED)):
                yield from folded(spelled[a : a + most])
                a += most
            waiting = [spelled[a:]]
    if waiting:
        yield from folded(np.concatenate(waiting))


def levels(code: Code, bits: int, kind: int, leaf: np.ndarray, context: np.ndarray):
    """(symbols, depth, outcome, node, slots) of the decisions of symbols of a kind at each depth; slots: the cells of the contexts, contexts x decisions."""
    length = code.length[leaf]
    order = np.argsort(-length, kind="stable")
    going = len(leaf) - np.cumsum(np.bincount(length))
    path = code.path[leaf[order]]
    # (context + node * odd) * base, the products taken once a symbol and once a decision
    context = context[:, order] * np.uint64(T._BASE)
    for depth, n in enumerate(going[:-1].tolist()):
        node = path[:n] >> np.uint64(63 - depth)
        bit = (node & np.uint64(1)).astype(np.int8)
        node >>= np.uint64(1)
        node = node.view(np.int64)
        node += code.base[kind][depth]
        spread = node.view(np.uint64) * _SPREAD
        slots = np.empty((CONTEXTS, n), np.int64)
        for k in range(CONTEXTS):
            hashed = slots[k].view(np.uint64)
            np.add(context[k, :n], spread, out=hashed)
            hashed >>= np.uint64(64 - bits)
            if k:
                hashed |= np.uint64(k << bits)
        yield order[:n], depth, bit, node, slots


def decisions(code: Code, bits: int, leaf: np.ndarray, context: np.ndarray):
    """(symbol number, depth, outcome, node, slots) of all decisions of any symbols, kind by kind and level by level."""
    kinds = np.searchsorted(code.first, leaf, side="right") - 1
    parts = []
    for kind in KINDS:
        own = np.flatnonzero(kinds == kind)
        for of, depth, *rest in levels(code, bits, kind, leaf[own], context[:, own]):
            parts.append((own[of], np.full(len(of), min(depth, DEPTHS - 1)), *rest))
    return tuple(np.concatenate(x, axis=-1) for x in zip(*parts))


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """SCALE times the log odds of cells with such counts, in a byte."""
    return np.clip(np.rint((np.log(ones + PRIOR) - np.log(zeros + PRIOR)) * SCALE), -127, 127).astype(np.int8)


class Counts:
    """A task's counts of outcomes: by node, and by cell in 16 bits (both of a cell are halved while one is too large)."""

    def __init__(self, code: Code, bits: int):
        self.node = np.zeros((code.nodes, 2), np.int64)
        self.cell = np.zeros((CONTEXTS << bits, 2), "<u2")
        self.both = self.cell.view("<u4").reshape(-1)

    def add(self, node: np.ndarray, bit: np.ndarray, slots: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """Count outcomes, each so many times (half of ``_AT_ONCE`` at most). Returns (contexts + 1) x decisions, as :func:`odds`, of what was counted before."""
        out = np.empty((CONTEXTS + 1, len(node)), np.int8)
        pair = self.node.take(node, axis=0, mode="wrap").astype(np.float32)
        pair += np.float32(PRIOR)
        np.log(pair, out=pair)
        sure = (pair[:, 1] - pair[:, 0]) * np.float32(SCALE)
        out[0] = np.clip(np.rint(sure, out=sure), -127, 127, out=sure)
        np.add.at(self.node.reshape(-1), node * 2 + bit, np.int64(1) if times is None else times)
        one = bit.astype(np.uint32)
        one *= np.uint32(65535)
        one += np.uint32(1)
        cuts = range(0, len(node), _AT_ONCE)
        if times is not None:
            one *= times.astype(np.uint32)
            total = np.cumsum(times)
            cuts = np.searchsorted(total, np.arange(0, total[-1], _AT_ONCE // 2), side="right").tolist()
        for own in itertools.starmap(slice, itertools.pairwise([*cuts, len(node)])):
            for before, place in zip(out[1:, own], slots[:, own]):
                # a cell is counted right after it is read, while it is in the processor's cache
                pair = self.both.take(place, mode="wrap")
                if np.bitwise_or.reduce(pair, initial=0) & _FULL:
                    self.cell[np.unique(place[pair & _FULL > 0])] >>= 1
                np.add.at(self.both, place, one[own])
                logs = _LOGS.take(pair.view("<u2"), mode="clip")
                sure = logs[1::2] - logs[::2]
                sure += np.int16(64)
                sure >>= np.int16(7)
                before[:] = np.clip(sure, np.int16(-127), np.int16(127), out=sure)
        return out

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(block, touched cells) of the nodes (from block 0 on) and then of the contexts' cells; :func:`_cells` reads them."""
        size, base = 1 << BLOCK_BITS, 0
        for table in (self.node, self.cell):
            for a in range(0, len(table), size):
                own = table[a : a + size]
                touched = np.flatnonzero(own[:, 0] | own[:, 1])
                if len(touched):
                    parts = (touched.astype("<u2"), *own[touched].T.copy())
                    # byte by byte, as the high ones are mostly 0
                    yield base + a // size, b"".join(x.view(np.uint8).reshape(len(touched), -1).T.tobytes() for x in (np.full(len(touched), table.itemsize, np.uint8), *parts))
            base += -(-len(table) // size)


def _cells(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes, width = np.frombuffer(packed, np.uint8), packed[0]
    planes = planes.reshape(3 + 2 * width, -1)
    read = lambda a, n: np.ascontiguousarray(planes[a : a + n].T).view(f"<u{n}").reshape(-1)
    return read(1, 2), np.stack([read(3, width), read(3 + width, width)], axis=1).astype(np.int64)


@dataclass
class Mixer:
    """Weights by gate and by depth, and the adaptive map by (kind and depth, stage)."""

    by_gate: np.ndarray
    by_depth: np.ndarray
    refined: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        stage = 1 / (1 + np.exp(-np.linspace(-8, 8, STAGES)))
        start = np.array([0.5, 0.2, 0.2, 0.2])
        return cls(np.tile(start, (len(KINDS) * LEVELS, 1)), np.zeros((len(KINDS) * DEPTHS, CONTEXTS + 1)), np.tile(stage, (len(KINDS) * DEPTHS, 1)))

    def ready(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts x (kind, depth, level): the two tables' sum, for odds as they are stored; the map and its steps."""
        joint = self.by_gate.reshape(len(KINDS), 1, LEVELS, -1) + self.by_depth.reshape(len(KINDS), DEPTHS, 1, -1)
        refined = self.refined.astype(np.float32).reshape(-1)
        return np.ascontiguousarray(joint.reshape(-1, CONTEXTS + 1).T / SCALE).astype(np.float32), refined, np.append(np.diff(refined), np.float32(0))

    @staticmethod
    def _level(raw):
        """How sure the contexts are."""
        sure = np.abs(raw[1:])
        level = (sure > 0).view(np.uint8) + (sure > 32).view(np.uint8)
        return (level[0] * np.uint8(9) + level[1] * np.uint8(3) + level[2]).astype(np.int64)

    @staticmethod
    def _mixed(weights, odds_, joint):
        z = weights[0].take(joint, mode="clip")
        z *= odds_[0]
        for own, x in zip(weights[1:], odds_[1:]):
            part = own.take(joint, mode="clip")
            part *= x
            z += part
        return z

    @staticmethod
    def _even(z):
        """The probability of outcome 1 at log odds ``z``."""
        p = np.exp(-z)
        p += 1
        return np.reciprocal(p, out=p)

    @staticmethod
    def _stage(z):
        place = z + np.float32(8)
        place *= np.float32((STAGES - 1) / 16)
        np.clip(place, 0, np.float32(STAGES - 1.001), out=place)
        low = place.astype(np.int64)
        place -= low.astype(np.float32)
        return low, place

    def chance(self, raw, kind, depth, ready: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """The probability of outcome 1 of each decision, in 32 bits."""
        weights, refined, steps = ready or self.ready()
        deep = kind * DEPTHS + depth
        z = self._mixed(weights, raw.astype(np.float32), self._level(raw) + deep * LEVELS)
        cell, part = self._stage(z)
        cell += deep * STAGES
        part *= steps.take(cell, mode="clip")
        part += refined.take(cell, mode="clip")
        part += self._even(z)
        part *= np.float32(0.5)
        return np.clip(part, np.float32(1e-6), np.float32(1 - 1e-6), out=part)

    def learn(self, raw, kind: int, depth: int, bit, times=None, rate: float = 0.05) -> None:
        """An online update of weights (AdaGrad on coding cost) and map by decisions of one kind and depth, each so many times."""
        if not hasattr(self, "square"):
            self.square = [np.full_like(self.by_gate, 1.0), np.full_like(self.by_depth, 1.0)]
            self.used = [np.zeros(len(self.by_gate)), np.zeros(len(self.by_depth)), np.zeros(self.refined.size)]
        gate, deep = slice(kind * LEVELS, (kind + 1) * LEVELS), kind * DEPTHS + depth
        weights = np.ascontiguousarray((self.by_gate[gate] + self.by_depth[deep]).T / SCALE).astype(np.float32)
        level, s = self._level(raw), raw.astype(np.float32)
        z = self._mixed(weights, s, level)
        s *= bit - self._even(z) if times is None else (bit - self._even(z)) * times.astype(np.float32)
        gradient = np.stack([np.bincount(level, x, LEVELS) for x in s], axis=1) / SCALE
        count = np.bincount(level, times, LEVELS)
        for k, (own, at, slope, n) in enumerate(((self.by_gate, gate, gradient, count), (self.by_depth, deep, gradient.sum(axis=0), count.sum()))):
            self.used[k][at] += n
            self.square[k][at] += slope**2
            own[at] += rate * slope / np.sqrt(self.square[k][at])
        cell, part = self._stage(z)
        cell += part > 0.5
        cell *= 2
        cell += bit
        outcome = np.bincount(cell, times, 2 * STAGES).reshape(-1, 2)
        count, ones = outcome.sum(axis=1), outcome[:, 1]
        self.used[2][deep * STAGES : (deep + 1) * STAGES] += count
        hit = np.flatnonzero(count)
        own = self.refined[deep]
        own[hit] += (1 - 0.98 ** count[hit]) * (ones[hit] / count[hit] - own[hit])

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights and map with a row for each count in ``used``."""
        return self.by_gate, self.by_depth, self.refined.reshape(-1, 1)


@dataclass
class Model:
    code: Code
    bits: int
    nodes: np.ndarray  # int8: SCALE times the log odds
    table: np.ndarray
    mixer: Mixer
    train_tokens: int
    distinct: int

    def code_length(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text."""
        t = _tokens(texts)
        return self.bits_of(t, self.code.find(t.word), len(texts), Spelt())

    def bits_of(self, t: Tokens, found: tuple[np.ndarray, np.ndarray], n: int, spelt: Spelt) -> np.ndarray:
        """Bits of each of ``n`` texts."""
        leaf, context, blank, word = _whole(self.code, t, found)
        spelled, of = _spelled(t.data, *_runs(t, blank, word))
        value, which = np.unique(spelled, return_inverse=True)
        cost = spelt.get(value)
        new = np.isnan(cost)
        cost[new] = self._costs(BYTES, *_bytes(self.code, value[new]))
        spelt.put(value[new], cost[new])
        half = len(t.word)
        nats = [self._costs(BLANKS, leaf[:half], context[:, :half]), self._costs(WORDS, leaf[half:], context[:, half:]), cost[which]]
        row = np.concatenate([t.row, t.row, np.concatenate([t.row[blank], t.row[word]])[of]])
        return np.bincount(row, np.concatenate(nats), n) / np.log(2)

    def _costs(self, kind: int, leaf: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural logarithms of the inverse probabilities of symbols of a kind."""
        cost, ready = np.zeros(len(leaf)), self.mixer.ready()
        for a in range(0, len(leaf), PIECE):
            own = slice(a, a + PIECE)
            total, order = np.zeros(len(leaf[own])), None
            for of, depth, bit, node, slots in levels(self.code, self.bits, kind, leaf[own], context[:, own]):
                order = of if order is None else order  # those of later levels are the first of it
                raw = np.empty((CONTEXTS + 1, len(of)), np.int8)
                self.nodes.take(node, out=raw[0], mode="clip")
                self.table.take(slots, out=raw[1:], mode="wrap")
                p = self.mixer.chance(raw, kind, min(depth, DEPTHS - 1), ready)
                total[: len(of)] -= np.log(np.abs(p - (1 - bit).astype(np.float32)))
            if order is not None:
                cost[a + order] = total[: len(order)]
        return cost


def _gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n): counts of separators, words and bytes by hash or value; kind 3 has the bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[], []]
        byte_counts, size = np.zeros(257, np.int64), 0

        def folded(k: int) -> tuple[np.ndarray, np.ndarray]:
            value, which = np.unique(np.concatenate([v for v, _ in found[k]]), return_inverse=True)
            total = np.bincount(which, np.concatenate([n for _, n in found[k]]), len(value)).astype(np.int64)
            found[k] = [(value, total)]
            return value, total

        def out(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 1 << 16):
                part = key[a : a + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(part), kind, np.int32)), T.array(part), pa.array(n[a : a + (1 << 16)])], ["kind", "key", "n"])

        for batch in T.blocks(batches, "text"):
            t = _tokens(batch.column("text"))
            for k, hashed in enumerate((t.space, t.word)):
                found[k].append(np.unique(hashed, return_counts=True))
                if len(found[k]) > 16:
                    folded(k)
                    if len(found[k][0][0]) > 1 << 20:  # what a task holds stays small; Spark adds up
                        yield from out(k, *found[k].pop())
            byte_counts[:256] += np.bincount(t.data, minlength=256)
            byte_counts[256] += len(t.word)
            size += len(t.data)
        for k in (BLANKS, WORDS):
            if found[k]:
                yield from out(k, *folded(k))
        yield from out(BYTES, np.arange(257, dtype=np.uint64), byte_counts)
        yield from out(3, np.zeros(1, np.uint64), np.array([size]))

    return docs.mapInArrow(run, "kind int, key bigint, n bigint")


def _head(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted hashes, counts) of the ``limit`` most frequent ones, and the weight of all others and unseen ones."""
    total, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    head = counts.orderBy(F.desc("n"), "key").limit(limit).toArrow()
    key = head.column("key").to_numpy().astype(np.int64).view(np.uint64)
    n = head.column("n").to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], n[order], float(total - n.sum() + once + 1)


def _learned(docs: DataFrame, code: Code, bits: int) -> DataFrame:
    """(part, key, used, sums, cells) of each task: weights and map entries (part 0 to 2), and touched cells by block (part 3)."""
    shared = docs.sparkSession.sparkContext.broadcast(code)
    names = ["part", "key", "used", "sums", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mixer, counts = shared.value, Mixer.new(), None
        for kind, leaf, context, times in to_learn(own, (batch.column("text") for batch in T.blocks(batches, "text", STEP_BYTES))):
            counts = counts or Counts(own, bits)
            for of, depth, bit, node, slots in levels(own, bits, kind, leaf, context):
                often = None if times is None else times[of]
                mixer.learn(counts.add(node, bit, slots, often), kind, min(depth, DEPTHS - 1), bit, often)
        if counts is None:
            return
        for k, (values, used) in enumerate(zip(mixer.parts(), mixer.used)):
            hit = np.flatnonzero(used)
            sums = pa.FixedSizeListArray.from_arrays(pa.array((values[hit] * used[hit, None]).reshape(-1)), values.shape[1])
            n = len(hit)
            yield pa.record_batch(
                [pa.array(np.full(n, k, np.int32)), pa.array(hit), pa.array(used[hit]), sums.cast(pa.list_(pa.float64())), pa.nulls(n, pa.binary())], names
            )
        for block, cells in counts.blocks():
            yield pa.record_batch(
                [pa.array([3], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([cells], pa.binary())],
                names,
            )

    return docs.mapInArrow(run, "part int, key bigint, used double, sums array<double>, cells binary")


def _summed(learned: DataFrame, n_nodes: int, bits: int) -> tuple[np.ndarray, np.ndarray, Mixer]:
    """The log odds of all nodes and cells, and the averaged weights and map, from the tasks' parts. As many bytes come to the driver."""
    names = ["part", "key", "used", "sums", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(own: tuple[int, int], used, total: np.ndarray) -> pa.RecordBatch:
            cells = odds(total[:, 0], total[:, 1]).tobytes() if own[0] == 3 else None
            sums = None if own[0] == 3 else total
            return pa.record_batch(
                [pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int64()), pa.array([used], pa.float64()), pa.array([sums], pa.list_(pa.float64())), pa.array([cells], pa.binary())],
                names,
            )

        own, used, total = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "used", "sums")]
            for part, key, n, sums, cells in zip(*columns, batch.column("cells")):
                if (part, key) != own:
                    if own is not None:
                        yield done(own, used, total)
                    own = (part, key)
                    used, total = (None, np.zeros((1 << BLOCK_BITS, 2), np.int64)) if part == 3 else (0.0, np.zeros(len(sums)))
                if part == 3:
                    place, count = _cells(cells.as_buffer().to_pybytes())
                    if len(place) == len(total):
                        total += count
                    else:
                        total[place] += count
                else:
                    used, total = used + n, total + sums
        if own is not None:
            yield done(own, used, total)

    size = 1 << BLOCK_BITS
    n_blocks = -(-n_nodes // size)
    nodes, table = np.zeros(n_blocks * size, np.int8), np.zeros(max(CONTEXTS << bits, size), np.int8)
    mixer = Mixer.new()
    parts = mixer.parts()
    dealt = learned.repartition("part", "key").sortWithinPartitions("part", "key")
    for row in dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in learned.schema)).toLocalIterator():
        key = row["key"]
        if row["part"] < 3:
            parts[row["part"]][key] = np.array(row["sums"]) / row["used"]
            continue
        target, at = (nodes, key) if key < n_blocks else (table, key - n_blocks)
        target[at * size : (at + 1) * size] = np.frombuffer(bytes(row["cells"]), np.int8)[: len(target) - at * size]
    return nodes[:n_nodes], table, mixer


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the stored word counts (key, n), from the rows for which ``where`` (on ``id``) holds."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(where).select("text")
    gathered = stored(_gathered(rows).groupBy("kind", "key").agg(F.sum("n").alias("n")), "symbols")
    counts = gathered.where(f"kind = {WORDS}").select("key", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bytes_ = np.zeros(258, np.int64)
    for kind, key, n in gathered.where(f"kind >= {BYTES}").select("kind", "key", "n").collect():  # 258 rows
        bytes_[key if kind == BYTES else 257] += n
    code = Code.build(*_head(gathered.where(f"kind = {BLANKS}"), HEAD_BLANKS), *_head(counts, HEAD_WORDS), bytes_[:257])
    bits = int(np.clip(int(bytes_[257]).bit_length(), BLOCK_BITS, TABLE_BITS))
    tasks = max(1, -(-int(bytes_[257]) // TASK_BYTES))
    nodes, table, mixer = _summed(_learned(rows.coalesce(tasks), code, bits), code.nodes, bits)
    return Model(code, bits, nodes, table, mixer, int(total), int(distinct)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, bits, n_tokens, n_known, base_score, score) of every row.

    Counts of frequent words are looked up in the broadcast head; each text's other
    words are joined with the counts, and their sum comes back to its row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    norm = model.train_tokens + 0.5 * (model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spelt = shared.value, Spelt()
        own.table = own.table.copy()  # in memory of its own, which comes in large pages
        for batch in T.blocks(batches, "text", STEP_BYTES):
            n = batch.num_rows
            texts = batch.column("text")
            t = _tokens(texts)
            found = own.code.find(t.word)
            bits = own.bits_of(t, found, n, spelt)
            _, offsets = T.utf8(texts)
            word, row = t.word, t.row
            count, known = own.code.counts(found)
            base = np.bincount(row[known], np.log10((count[known] + 0.5) / norm), n)
            n_known = np.bincount(row, known, n).astype(np.int64)
            # each text's other words, once each
            rest, rest_row = word[~known], row[~known]
            order = np.lexsort((rest, rest_row))
            rest, rest_row = rest[order], rest_row[order]
            first = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_row[1:] != rest_row[:-1])])[: len(rest)])
            rest = pa.StructArray.from_arrays([T.array(rest[first]), pa.array(np.diff(np.append(first, len(rest))))], ["key", "k"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest_row[first], np.arange(n + 1)), pa.int32()), rest)
            yield pa.record_batch(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(bits), pa.array(np.bincount(row, minlength=n)), pa.array(n_known), pa.array(base), rest],
                ["id", "n_bytes", "bits", "n_tokens", "n_known", "base", "rest"],
            )

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    first = named.mapInArrow(run, "id bigint, n_bytes bigint, bits double, n_tokens bigint, n_known bigint, base double, rest array<struct<key: bigint, k: bigint>>")
    first = stored(first.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rest = first.select("uid", F.inline("rest"))
    joined = rest.join(counts.hint("shuffle_hash"), "key", "left")  # neither side needs an order
    term = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(norm))
    found = joined.groupBy("uid").agg(
        F.sum(F.col("k") * term).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("known")
    )
    out = first.drop("rest").join(found, "uid", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "bits",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row by a model of the rows outside the fold."""
    model, counts = train(docs, ~held_out(F.col("id"), folds, fold), id_col, text_col)
    out = score(docs, model, counts, id_col, text_col)
    return out.select(
        id_col,
        held_out(F.col(id_col), folds, fold).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
