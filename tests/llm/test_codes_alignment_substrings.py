"""Vector codes, tokenizer alignment and substring dedup against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelquant.llm import alignment, substrings, vector_codes
from panelquant.llm.fm_index import FmIndex, suffix_array
from panelquant.llm.tokenizer import tokenizer_path

from .test_operators import EDGE, docs_of, sentence

# 11 -----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, vector string, error bigint, key string, near int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x, label, "v", 1, "k", 2) for i, x, label in rows], VECTORS)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * c) for c in np.float32(x).tolist()], label) for i, x, label in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        groups = defaultdict(list)
        for x in cut:
            for p in range(parts):
                groups[p, nearest(x[p], books[p])[1]].append(x[p])
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], digest) for (i, _, label), f, error in zip(kept, found, errors)), key=str)


@pytest.mark.parametrize("n,spread", [(300, 1.0), (120, 0.002), (9, 1.0)])
def test_vector_codes_match_brute_force(spark, n, spread):
    """Far and near vectors (whose distances tie), fewer vectors than entries, bad rows, repeated rows and null labels."""
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    rows = [(i * 7 % 301, [c + rng.gauss(0, 0.3) * spread for c in (rng.choice(centres) if spread == 1 else [0.5] * 16)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(500, None, 1), (501, [None] * 16, 1), (502, [math.nan] * 16, 1), (503, [1.0] * 15 + [math.inf], 2), rows[0], (None, rows[1][1], 1)]
    got = vector_codes.compress(vectors_of(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_vector_codes_of_empty_and_uneven_tables(spark):
    empty = vector_codes.compress(vectors_of(spark, [(1, None, 1)]))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    for bad in ([(1, [1.0] * 12, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 8, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(vectors_of(spark, bad))


def test_bounds_decide_as_measuring_does():
    """Many rounds with lists that shrink and grow; each assignment is the exact nearest."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-50, 50, (400, 16))
    books = vector_codes.Codebooks(vectors[:16].reshape(16, 8, 2).transpose(1, 0, 2).copy())
    block = vector_codes.Block(vectors, books)
    block.start(4)
    spared = 0
    for step in range(12):
        later = vector_codes.Codebooks(books.entries + rng.integers(-3, 4, books.shape) // (1 + step // 4))
        block.books = later
        need = block.advance(books.movements(later), [4, 2, 7, 1, 15][step % 5])
        books, spared = later, spared + need[:-1].sum()
        every = np.broadcast_to(np.arange(16), (len(block.x), 16))
        assert (block.near[:, 0] == block.distances(np.arange(len(block.x)), every).argmin(1)).all()
    assert spared > 0


def test_list_length_follows_need():
    assert vector_codes.adapted(4, np.array([10, 0, 0, 0, 0, 90]), 16) == 6
    assert vector_codes.adapted(6, np.array([90, 5, 4, 1, 0, 0, 0, 0]), 16) == 2


# 12 -----------------------------------------------------------------------------------------------------------

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute_alignment(texts):
    both = alignment.Tokenizers(*PATHS)
    found, counts = [], Counter()
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if not text or any(b"".join(x[i] for i in ids) != (" " + text).encode() for x, ids in ((both.a_bytes, a), (both.b_bytes, b))):
            found.append(([], [], [], Counter()))
            continue
        groups, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                own[0].append(a[i])
                at_a, i = at_a + len(both.a_bytes[a[i]]), i + 1
            else:
                own[1].append(b[j])
                at_b, j = at_b + len(both.b_bytes[b[j]]), j + 1
            if at_a == at_b:
                groups.append(own)
                own = ([], [])
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        counts.update(links.keys())
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        yield len(a), len(b), len(groups), sum(links.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""


ODD = ["a▁b", "<s>hi</s> <unk><|endoftext|> <0x0A>", "x" * 3000, "你好 " * 400, "tab\there  two\n\n three\r\n", "it's, o'clock_s don't!", "　wide  space  x", "\x00\x01 \x7f", " lead and trail  ", "🎉👩‍👩‍👧" * 40]


@pytest.mark.parametrize("size,context,fan", [(1 << 15, 1 << 12, 16), (300, 100, 2), (64, 8, 3), (1, 0, 4)])
def test_alignment_matches_brute_force(spark, sf_dir, size, context, fan):
    """The same rows wherever texts are cut: whole texts, trees of several levels, borders inside words, and words without a place to cut."""
    rng = random.Random(12)
    texts = EDGE + ODD + [" ".join(rng.choice(ODD + EDGE[4:6] + ["plain words, here", "Zürich-West"]) for _ in range(6)) for _ in range(8)]
    if size == 1:
        texts = [t and t[:40] for t in texts]
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = alignment.digest(docs_of(spark, texts), *PATHS, range_bytes=size, context_bytes=context, fan=fan).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(texts)
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got}
    assert [rows[i] for i in range(len(texts))] == list(brute_alignment(texts))


def test_alignment_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.digest(docs, *PATHS).collect()}
    assert [rows[i] for i in range(len(texts))] == list(brute_alignment(texts))
    assert alignment.digest(docs_of(spark, []), *PATHS).count() == 0


def test_fragments_are_a_monoid():
    """Composing neighbours in any order closes the same groups."""
    rng = random.Random(3)

    def leaf(k):
        tokens = lambda: ([rng.randrange(9) for _ in range(rng.randrange(3))], [rng.randrange(9) for _ in range(rng.randrange(3))])
        return alignment.Fragment(tokens(), True, tokens(), 10 * k, 10 * k + 5) if rng.random() < 0.6 else alignment.Fragment(tokens())

    for _ in range(50):
        parts, results = [leaf(k) for k in range(7)], []
        for _ in range(4):
            left, closed = list(parts), []
            while len(left) > 1:
                k = rng.randrange(len(left) - 1)
                whole, group = left[k].then(left[k + 1])
                left[k : k + 2] = [whole]
                closed += [group] if group else []
            results.append((left[0], sorted(closed)))
        assert all(r == results[0] for r in results)


# 13 -----------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window=20):
    """rows: (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    place = lambda i, k: (rows[i][0] is None, rows[i][0] or 0, k)
    least = {}
    for i, own in enumerate(words):
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            least[key] = min(least.get(key, place(i, k)), place(i, k))
    out = []
    for i, own in enumerate(words):
        gone = {k + j for k in range(len(own) - window + 1) if least[tuple(own[k : k + window])] < place(i, k) for j in range(window)}
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((rows[i][0], len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def passages(rng, n):
    base = [sentence(rng, rng.randrange(15, 60)) for _ in range(12)]
    for i in range(n):
        parts = [rng.choice(base) if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))]
        words = " ".join(parts).split(" ")
        a = rng.randrange(len(words))
        yield rng.randrange(n) if rng.random() < 0.1 else i, ("\n" if i % 3 else " ").join(words[a:] if i % 4 == 0 else words)


@pytest.mark.parametrize("options", [{}, {"hot": 1, "shard_words": 200, "buckets": 3}, {"hot": 0}, {"gram": 20}, {"gram": 1}])
def test_substring_dedup_matches_brute_force(spark, options):
    """Passages at any place, whole copies, repeated ids and rows, a periodic text, and a null id; hot minimizers dealt by windows."""
    rng = random.Random(13)
    rows = [(1000 + i, t) for i, t in enumerate(EDGE)] + list(passages(rng, 120))
    rows += [rows[-1], (None, rows[-2][1]), (None, None), (2000, "x y " * 60), (2001, "Ä\x0b " * 30 + "\t"), (2002, "one two " * 9)]
    got = substrings.drop_repeats(docs_of(spark, rows).repartition(5), with_text=True, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)


def test_substring_dedup_of_many_copies(spark):
    text = sentence(random.Random(4), 60)
    rows = [(i, text if i % 3 else f"head{i} {text} tail{i}") for i in range(200)]
    got = substrings.drop_repeats(docs_of(spark, rows).repartition(4), with_text=True)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)
    assert substrings.drop_repeats(docs_of(spark, [])).count() == 0


def test_index_finds_matching_statistics():
    rng = np.random.default_rng(6)
    for _ in range(20):
        parts = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        symbols = np.concatenate([np.append(p, 0) for p in parts])
        text = "".join(map(str, symbols))
        separators = np.cumsum(symbols == 0)
        key = [[(1, x) if x else (0, separators[i + j]) for j, x in enumerate(symbols[i:])] for i in range(len(symbols))]
        assert suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=key.__getitem__)
        query = rng.integers(1, 5, 40)
        query[query > symbols.max()] = symbols.max()
        index = FmIndex(symbols)
        ends = np.arange(1, 41)
        match, low, high = index.search(query, ends, 7, least=1)
        for end, m, a, b in zip(ends, match, low, high):
            found = lambda k: sum(text.startswith("".join(map(str, query[end - k : end])), i) for i in range(len(text)))  # noqa: E731,B023
            assert m == max(k for k in range(min(7, end) + 1) if found(k) or not k)
            assert not m or b - a == found(m)
