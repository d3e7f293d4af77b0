"""Linking inside groups, packed shuffles, and the operators' behaviour on repeated and missing ids."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from panelquant.llm import counters, decontaminate, line_dedup, linking, mixing, ngram_join, packed, quality, toxicity
from tests.llm.test_operators import brute_components, brute_lines, docs_of, edited, sentence


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def near_sets(rng, n, edits):
    """Variants of one set, variants of a far variant, and strangers."""
    base = [rng.randrange(1, 1 << 63) for _ in range(60)]
    far = base[:30] + [rng.randrange(1, 1 << 63) for _ in range(30)]
    out = []
    for i in range(n):
        own = list(base if i % 3 else far)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(60)] = rng.randrange(1, 1 << 63)
        out.append(sorted(set(own)))
    return out


@pytest.mark.parametrize("limits", [{}, {"members": 4, "few": 3}, {"members": 4, "few": 2, "levels": 1}, {"delta_bytes": 64, "few": 4, "levels": 0}])
def test_link_finds_every_link_of_a_group(spark, limits):
    """Whole groups in a task, prefixes of deltas over several levels, and the last level's pairs agree with all pairs."""
    rng = random.Random(5)
    sets = near_sets(rng, 70, 9)
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))]
    want = least_reachable(range(len(sets)), links)
    items = spark.createDataFrame([(i, np.array(x, np.uint64).tobytes()) for i, x in enumerate(sets)], "node bigint, content binary")
    pairs = spark.createDataFrame([(i, 0, True) for i in range(1, len(sets))], "x bigint, p bigint, star boolean")
    counts = counters.Counts()
    for x in sets:
        counts.add(np.array(x, np.uint64))
    level = np.minimum(8 * np.log2(1 + counts.counts), 254).astype(np.uint8)
    labels = linking.link(pairs, items, linking.packed_sets, spark.sparkContext.broadcast(level), 4, 5, **limits)
    got = {r["node"]: r["component"] for r in labels.collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert len(set(want.values())) > 2


def test_meetings_of_a_group_that_comes_in_pieces():
    dtype = np.dtype([("key", "<u8"), ("order", "<u2"), ("node", "<i8")])
    rng = np.random.default_rng(2)
    records = np.zeros(5000, dtype)
    records["key"] = np.where(rng.random(5000) < 0.3, 7, rng.integers(0, 2000, 5000))
    records["node"] = np.arange(5000)
    records["order"] = rng.integers(0, 9, 5000)
    pairs = [(x, p) for x, p, _ in packed.meetings(iter(np.array_split(records, 40)), 1, packed.no_pairs, limit=300)]
    links = [(int(a), int(b)) for x, p in pairs for a, b in zip(x, p)]
    same = least_reachable(range(5000), links)
    first = {}
    for r in records:
        first.setdefault(int(r["key"]), int(r["node"]))
    assert all(same[int(r["node"])] == first[int(r["key"])] for r in records)


def test_packed_rows_come_back():
    dtype = np.dtype([("key", "<u8"), ("n", "<i4")])
    records = np.zeros(100, dtype)
    records["key"], records["n"] = np.arange(100) % 7, np.arange(100)
    batch = packed.rows((records["key"] % 3).astype(np.int64), records, 1)
    back = [(b, packed.unpack(column, dtype)) for b, pieces in packed.by_bucket([batch, batch]) for _, column in pieces]
    assert [b for b, _ in back] == [0, 1, 2, 0, 1, 2]
    assert sorted(n for _, own in back[:3] for n in own["n"]) == list(range(100))
    assert all((own["key"] % 3 == b).all() for b, own in back)


def test_line_shingles_match_plain_windows():
    lines = [b"abcdefgh", "äöüßabc 你好 long line".encode(), b"aaaaaaaaaaaaaaa"]
    value, line = line_dedup.char_shingles(lines, 8)
    for i, x in enumerate(lines):
        text = x.decode()
        windows = [text[k : k + 8] for k in range(len(text) - 7)]
        assert (line == i).sum() == len(windows) and len(set(value[line == i].tolist())) == len(set(windows))


def test_line_dedup_of_rows_that_share_or_lack_an_id(spark):
    """Unlike texts of one id don't lose lines that they alone have; rows without id come last; whole repeats are treated alike."""
    a, b, c = ("first line of text %s" % x * 2 for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (3, c), (3, c)]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.drop_duplicate_lines(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, ""), (2, b), (None, ""), (None, ""), (3, c), (3, c)], key=str)


def test_line_dedup_recall_by_similarity(spark):
    """Pairs of similarity 0.8 and more, all lengths: nearly all are found; what differs more stays."""
    rng = random.Random(8)
    texts = []
    for k in range(150):
        line = sentence(rng, 8 + k % 40, 10**6)
        texts += [line, edited(rng, line, 1 + k % 3)]
    gone = {i for i, _ in brute_lines(texts)}
    found = {r["doc_id"] for r in line_dedup.drop_duplicate_lines(docs_of(spark, texts)).where("n_dropped > 0").collect()}
    assert found <= gone and len(found) >= 0.97 * len(gone) and len(gone) > 50


def test_ngram_join_of_a_large_group(spark):
    rng = random.Random(21)
    base = sentence(rng, 120, 10**6)
    texts = [edited(rng, base, rng.randrange(7)) for _ in range(60)] + [sentence(rng, 40, 10**6) for _ in range(10)]
    want = {i: c for i, (_, c) in brute_components(list(enumerate(texts))).items()}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == want


def test_decontamination_keeps_equal_shards_apart(spark):
    """Repeated rows in shards of equal contents all come out, however many blocks the benchmark has."""
    docs = docs_of(spark, [(1, "one two three"), (1, "one two three"), (1, "one two three"), (2, "x y")]).repartition(2)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "two three", "y", "nothing", "one two three four five"])], "item_id bigint, text string")
    want = None
    for chars in (1 << 20, 8, 1):
        index = decontaminate.build_index(docs, shard_bytes=1)
        rows = [tuple(r) for r in decontaminate.digest(decontaminate.contamination(index, items, query_chars=chars)).collect()]
        assert len(rows) == 4
        want = want or sorted(rows, key=str)
        assert sorted(rows, key=str) == want


def test_classifiers_and_scores_of_ids_that_repeat(spark):
    """Every row comes out once with the score of its own text."""
    rng = random.Random(3)
    texts = [(i % 20, ("good clear text " if i % 2 else "spam buy now ") * 3 + sentence(rng, 10)) for i in range(40)] + [(None, "good clear text")]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for classify in (quality.classify, toxicity.classify):
        assert classify(docs, labels).count() == len(texts)
    scored = mixing.score_documents(docs).collect()
    assert len(scored) == len(texts) and len({r["score"] for r in scored}) > 20


def test_component_labels_are_least_nodes():
    links = linking.group_links(
        np.array([5, 9, 7]), np.array([4, 4, 4]), np.array([2, 2, 8]), np.array([1, 2, 1, 2, *range(10, 18)], np.uint64), np.array([0, 2, 4, 12]), 4, 5
    )
    assert links == [(9, 5)]
    assert pa.types.is_int64(linking.pair_batch(np.array([2, 2, 3]), np.array([1, 1, 3]), True).column("x").type)
