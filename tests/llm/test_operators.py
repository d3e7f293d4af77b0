"""The ten operators against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelquant.llm import chat, decontaminate, entry, fingerprint, langid, line_dedup, mixing, ngram_join, packing, quality, toxicity
from panelquant.llm.components import components
from panelquant.llm.scratch import stored
from panelquant.llm.tokenizer import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, id string, sig int"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts):
    """Documents with clashing extra columns; ids from 0 unless (id, text) pairs are given."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return frame(spark, [(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in rows])


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


EDGE = ["", None, " \n\t ", "one", "Über ß 你好  x", "a\nb\n\nc", "word " * 3000, "same text here now", "same text here now"]


# 1 ------------------------------------------------------------------------------------------------------------


def test_fingerprint_edits_match_brute_force(spark):
    rng = random.Random(1)
    texts = EDGE + [sentence(rng, rng.randrange(1, 80)) + "\n" + sentence(rng, 30) for _ in range(40)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_with_edits(docs_of(spark, texts), bucket_rows=7).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        own, following = text or "", texts[(i - 1) % len(texts)] or ""
        k = len(own) // 3
        want = own[: len(own) - k] + following[:k]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[8]["near_next"] == 1.0
    near = [got[i]["near_edited"] > got[i]["near_next"] for i in range(len(EDGE), len(texts))]
    assert np.mean(near) > 0.95


def test_fingerprint_is_homomorphic():
    both = fingerprint.encode(*fingerprint.vectors(pa.array(["a b c\nd e f", "d e f\na b c", "a b c"])))
    assert both[0] == both[1] != both[2]
    assert fingerprint.insert(both[2], "d e f") == both[0]
    assert fingerprint.delete(both[0], "d e f") == both[2]


def test_fingerprint_of_empty_and_single_tables(spark):
    assert fingerprint.fingerprint_with_edits(docs_of(spark, [])).count() == 0
    row = fingerprint.fingerprint_with_edits(docs_of(spark, [(None, "abc")])).first()
    assert row["doc_id"] is None and row["near_next"] == 1.0
    assert fingerprint.fingerprint_documents(docs_of(spark, EDGE)).count() == len(EDGE)


# 2 ------------------------------------------------------------------------------------------------------------


def brute_lines(texts, size=line_dedup.SHINGLE):
    lines = []
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            line = line.translate(LOWER).strip(" \t\r\x0b\x0c")
            if len(line) >= line_dedup.MIN_CHARS:
                lines.append(((i, k), {line[j : j + size] for j in range(len(line) - size + 1)}))
    parent = {key: key for key, _ in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(lines, 2):
        if 5 * len(x & y) >= 4 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {key for key in parent if find(key) != key}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    base = [sentence(rng, 14) for _ in range(25)]
    texts = list(EDGE)
    for _ in range(60):
        own = [rng.choice(base) if rng.random() < 0.5 else edited(rng, rng.choice(base), 1) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join([*own, "short", "", "  " + own[0].upper() + " "]))
    gone = brute_lines(texts)
    rows = {r["doc_id"]: r for r in line_dedup.drop_duplicate_lines(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        assert rows[i]["text"] == want
        assert rows[i]["n_dropped"] == sum(key[0] == i for key in gone)


def test_line_dedup_empty_table(spark):
    assert line_dedup.drop_duplicate_lines(docs_of(spark, [])).count() == 0
    assert line_dedup.drop_duplicate_lines(docs_of(spark, [None, ""])).count() == 2


def test_line_dedup_with_columns_of_its_own_names(spark):
    names = ["__doc", "__key", "__lines", "own_doc", "OWN_KEY", "own_lines", "doc", "key", "line"]
    docs = docs_of(spark, ["a line of text\nother words here", "a line of text"])
    for name in names:
        docs = docs.withColumn(name, docs["doc_id"] + 7)
    rows = {r["doc_id"]: r for r in line_dedup.drop_duplicate_lines(docs).collect()}
    assert rows[0]["n_dropped"] == 0 and rows[1]["text"] == "" and all(rows[1][c] == 8 for c in names)


def test_line_dedup_short_lines(spark):
    """Lines of 8 to 19 characters count, near copies included; shorter ones are kept."""
    texts = ["Subscribe now\n}\nMenu", "  subscribe NOW \n}\nMenu", "12345678\n1234567", "12345678\n1234567", "今日はとても良い天気です。\nabcdefghijklmnopqr", "今日はとても良い天気です。\nabcdefghijklmnopqrs"]
    want = ["Subscribe now\n}\nMenu", "}\nMenu", "12345678\n1234567", "1234567", texts[4], ""]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.drop_duplicate_lines(docs_of(spark, texts)).collect()}
    assert [rows[i] for i in range(6)] == want


# 3 ------------------------------------------------------------------------------------------------------------


def test_mixing_base_scores_and_held_out_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0"] for i, t in rows.items()}
    train = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    total, distinct = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in entry.op3_lm_scoring(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for i, own in tokens.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), total)
        base = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0


def random_model(rng, words=("stone", "river", "cloud"), bits=16):
    """A model with random trees, tables, weights and map."""
    key = lambda parts: np.sort(np.concatenate([mixing.T.hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in parts]))
    known = np.sort(np.append(key([w.encode() for w in words]), np.uint64(mixing.END_WORD)))
    blanks = key([b"", b" "])
    code = mixing.Code.build(blanks, np.array([2, 9]), 1.0, known, rng.integers(2, 9, len(known)), 2.0, rng.integers(0, 5, 257))
    mixer = mixing.Mixer.new()
    mixer.by_gate[:] = rng.normal(0.4, 0.2, mixer.by_gate.shape)
    mixer.by_depth[:] = rng.normal(0, 0.1, mixer.by_depth.shape)
    mixer.refined[:] = rng.uniform(0.01, 0.99, mixer.refined.shape)
    small = lambda n: rng.integers(-90, 90, n).astype(np.int8)
    return mixing.Model(code, bits, small(code.nodes), small(mixing.CONTEXTS << bits), mixer, 9, 4)


def test_mixing_is_a_probability():
    """The outcomes of every decision add up to 1, so all leaves of a tree do, in any context."""
    rng = np.random.default_rng(3)
    model = random_model(rng)
    code = model.code
    for kind, (a, b) in enumerate(itertools.pairwise([*code.first, len(code.start)])):
        leaf = np.arange(a, b)
        context = np.tile(rng.integers(0, 1 << 60, (3, 1)).astype(np.uint64), (1, len(leaf)))
        of, depth, bit, node, slots = mixing.decisions(code, model.bits, leaf, context)
        p = model.mixer.chance(np.concatenate([model.nodes[node][None], model.table[slots]]), np.full(len(of), kind), depth)
        assert np.exp(np.bincount(of, np.log(np.where(bit == 1, p, 1 - p)))).sum() == pytest.approx(1.0, abs=1e-6)


def test_mixing_score_matches_plain_loops():
    """Code lengths against a symbol-by-symbol computation with Python's own integers."""
    rng = np.random.default_rng(5)
    model = random_model(rng)
    code, mask = model.code, (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    def joined(*parts):
        out = len(parts)
        for p in parts:
            out = mix(out * 0x9E3779B97F4A7C15 + p & mask)
        return out

    def hashed(x):
        value = [mix((b + 1) * 0x9E3779B97F4A7C15 & mask) for b in x]
        return mix(sum(v * pow(0x5851F42D4C957F2D, k, 1 << 64) for k, v in enumerate(value)) + len(x) * 0x9E3779B97F4A7C15 & mask)

    def cost(leaf, kind, contexts):
        bits = 0.0
        for k in range(code.length[leaf]):
            node, bit = int(code.node[code.start[leaf] + k]), int(code.bit[code.start[leaf] + k])
            cells = [((c + node * 0x9E3779B97F4A7C15) * 0x5851F42D4C957F2D & mask) >> (64 - model.bits) for c in contexts]
            raw = [int(model.nodes[node])] + [int(model.table[(i << model.bits) + c]) for i, c in enumerate(cells)]
            gate = kind * 27 + sum(w * ((abs(r) > 0) + (abs(r) > 32)) for w, r in zip((9, 3, 1), raw[1:]))
            deep = kind * 8 + min(k, 7)
            z = sum(r / 16 * (a + b) for r, a, b in zip(raw, model.mixer.by_gate[gate], model.mixer.by_depth[deep]))
            place = min(max((z + 8) * 2, 0), 31.999)
            low = int(place)
            refined = model.mixer.refined[deep, low] * (1 - place + low) + model.mixer.refined[deep, low + 1] * (place - low)
            p = min(max((1 / (1 + math.exp(-z)) + refined) / 2, 1e-6), 1 - 1e-6)
            bits -= math.log2(p if bit else 1 - p)
        return bits

    def spelled(x):
        bits = 0.0
        for k, b in enumerate([*x, 256]):
            back = [x[k - j] + 1 if k >= j else 0 for j in (1, 2, 3, 4, 5)]
            bits += cost(code.first[2] + b, 2, [joined(*back[:2]), joined(*back[:3]), joined(*back)])
        return bits

    texts = ["", "stone river", "Stone  RIVER unseen cloud\n", " über stone", "stone stone river stone stone river"]
    got = model.code_length(pa.array(texts))
    for text, found in zip(texts, got):
        parts = re.split(rb"([^\x20\x09-\x0d]+)", text.translate(LOWER).encode())
        want, back, before = 0.0, [0, 0, 0], 0
        for space, word in zip(parts[::2], [*parts[1::2], None]):
            own = [joined(*back[:k]) for k in (1, 2, 3)]
            space_key, key = hashed(space), mixing.END_WORD if word is None else hashed(word)
            at = {int(h): i for i, h in enumerate(code.blanks)}.get(space_key)
            want += cost(len(code.blanks) if at is None else at, 0, [own[0], own[1], joined(back[0], before)])
            want += 0 if at is not None else spelled(space)
            at = {int(h): i for i, h in enumerate(code.words)}.get(key)
            want += cost(code.first[2] - 1 if at is None else code.first[1] + at, 1, own)
            want += 0 if at is not None else spelled(word)
            back, before = [key, *back[:2]], space_key
        assert found == pytest.approx(want, rel=1e-4)


def test_mixing_learns_from_every_training_row(spark):
    """A small corpus fills the tables and the weights, each row's own text included."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(("stone", "river", "cloud", "amber")) + rng.choice("xyz") for _ in range(30)) + f" only{i}" for i in range(60)]
    model, counts = mixing.train(docs_of(spark, texts), mixing.F.lit(True))
    column = pa.array(texts)
    leaf, kind, _, context = mixing.symbols(model.code, column)
    of, _, bit, node, slots = mixing.decisions(model.code, model.bits, leaf, context)
    known = model.table[slots]
    assert (known != 0).mean() > 0.9 and ((known > 0) == (bit == 1)).mean() > 0.7
    assert ((leaf == model.code.first[2] - 1).sum(), counts.where("n = 1").count()) == (60, 60)
    # contexts tell more than the trees and the map know
    plain = mixing.Model(model.code, model.bits, np.zeros_like(model.nodes), np.zeros_like(model.table), model.mixer, 0, 0)
    assert model.code_length(column).sum() < 0.8 * plain.code_length(column).sum()
    fresh = mixing.Mixer.new()
    assert not np.allclose(model.mixer.by_gate, fresh.by_gate) and not np.allclose(model.mixer.refined, fresh.refined)


def test_mixing_folds_equal_spelled_bytes():
    """A word that is spelled often is worked out once, with the counts and costs of all its places."""
    model = random_model(np.random.default_rng(11))
    code, texts = model.code, pa.array(["unseen stone " * 300, "stone unseen river"] * 3)
    leaf, kind, _, context = mixing.symbols(code, texts)
    plain, folded = mixing.Counts(code, 16), mixing.Counts(code, 16)
    _, _, bit, node, slots = mixing.decisions(code, 16, leaf, context)
    plain.add(node, bit, slots)
    symbols, spelled = 0, (kind == mixing.BYTES).sum()
    for k, own, contexts, times in mixing.to_learn(code, [texts], [10**9] * 3):
        symbols += len(own) if k == mixing.BYTES else 0
        for of, _, bit, node, slots in mixing.levels(code, 16, k, own, contexts):
            folded.add(node, bit, slots, None if times is None else times[of])
    assert symbols < spelled / 50
    # words with a leaf are spelled once besides: stone and river
    assert folded.node.sum() - plain.node.sum() == sum(code.length[code.first[2] + b] for b in [*b"stoneriver", 256, 256])
    pieces = list(mixing.to_learn(code, [pa.array(["river stone"])] * 9, [10**9] * 3))
    assert sum(times.sum() for k, *_, times in pieces if k == mixing.BYTES) == len("river") + len("stone") + 2


def test_mixing_often_counted_cells_keep_their_ratio():
    """More equal bytes than a cell can hold are counted without overflow."""
    code = random_model(np.random.default_rng(7)).code
    spelled = np.full(mixing.SPELLED, ord("x"), np.uint64)
    texts = pa.array([" ".join(["x"] * mixing.SPELLED)])
    assert (mixing._spelled(np.frombuffer(b"x", np.uint8), np.array([0]), np.array([1]))[0][0] == spelled[0]).all()
    counts, total = mixing.Counts(code, 16), 0
    for kind, leaf, context, times in mixing.to_learn(code, [texts], [10**9] * 3):
        for of, _, bit, node, slots in mixing.levels(code, 16, kind, leaf, context):
            counts.add(node, bit, slots, None if times is None else times[of])
            total += len(of) if times is None else times[of].sum()
    assert counts.node.sum() == total
    x = code.first[2] + ord("x")
    _, _, bit, node, slots = mixing.decisions(code, 16, np.array([x]), mixing._bytes(code, spelled[:1])[1])
    own = counts.cell[slots[0]]
    assert (own[np.arange(len(bit)), bit] > 8000).all() and (own[np.arange(len(bit)), 1 - bit] < 100).all()


def test_mixing_counts_are_whole(spark):
    """Full cells keep their ratio, and packed blocks come back as they were."""
    code = random_model(np.random.default_rng(7)).code
    counts = mixing.Counts(code, 16)
    node, slots = np.zeros(70000, np.int64), np.tile(np.array([[5], [70000], [140000]]), (1, 70000))
    bit = (np.arange(70000) % 4 == 0).astype(np.int8)
    counts.add(node, bit, slots)
    counts.add(node, bit, slots)
    assert counts.node[0].tolist() == [105000, 35000]
    assert counts.cell[5][0] / counts.cell[5][1] == pytest.approx(3, rel=0.2)
    back = {block: mixing._cells(cells) for block, cells in counts.blocks()}
    assert back[0][0].tolist() == [0] and back[0][1].tolist() == [[105000, 35000]]
    assert back[1][0].tolist() == [5] and back[1][1][0].tolist() == counts.cell[5].tolist()


def test_mixing_edge_cases(spark):
    docs = docs_of(spark, EDGE)
    rows = {r["doc_id"]: r for r in mixing.score_documents(docs).collect()}
    assert len(rows) == len(EDGE) and rows[0]["n_tokens"] == 1 and rows[1]["score"] == rows[0]["score"]
    assert mixing.score_documents(docs_of(spark, [])).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [sentence(rng, n, 50) for n in (3, 9, 10, 11, 40)] + ["", None, "W1 w2"]
    texts = EDGE + [sentence(rng, 20, 50) + ". " + (rng.choice(items) or "") + "! " + sentence(rng, 9, 50) for _ in range(60)]
    texts += [sentence(rng, 60, 4) for _ in range(10)]
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    split = lambda t: re.findall(pattern, (t or "").translate(LOWER))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    index = decontaminate.build_index(docs_of(spark, texts), shard_bytes=3000)
    for chars in (1 << 20, 100):
        got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.contamination(index, bench, query_chars=chars)).collect()}
        for i, text in enumerate(texts):
            words, hit, found = split(text), set(), set()
            for item, t in enumerate(items):
                own = split(t)
                for w in {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else ():
                    for k in range(len(words) - len(w) + 1):
                        if tuple(words[k : k + len(w)]) == w:
                            hit |= set(range(k, k + len(w)))
                            found.add(str(item))
            digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            want = (len(words), len(hit), len(found), digest, bool(hit))
            assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_proximity_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 60, 12) for _ in range(20)] + EDGE
    index = decontaminate.build_index(docs_of(spark, texts), shard_bytes=1500)
    got = {(r["doc_id"], r["start"], r["end"]) for r in decontaminate.proximity(index, ["w1", "W2", "w3"], 8).collect()}
    want = set()
    for i, text in enumerate(texts):
        words = (text or "").translate(LOWER).split()
        spans = [(a, b) for a in range(len(words)) for b in range(a, min(a + 8, len(words))) if {"w1", "w2", "w3"} <= set(words[a : b + 1])]
        want |= {(i, a, b) for a, b in spans if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in spans)}
    assert got == want
    assert decontaminate.build_index(docs_of(spark, [])).count() == 0


# 5, 6 ---------------------------------------------------------------------------------------------------------


def test_transducers_compose():
    state, bits = toxicity.START_STATE, []
    for s in (toxicity.REPORT, toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.INSULT):
        state, out = toxicity.TABLE[state, s]
    assert out == (1, 0, 1, 1, 1)
    state = toxicity.START_STATE
    for s in (toxicity.NEGATION, *[toxicity.OTHER] * 3, toxicity.THREAT):
        state, out = toxicity.TABLE[state, s]
    assert out == (0, 1, 0, 0, 0)


@pytest.mark.parametrize("run", [toxicity.classify, quality.classify])
def test_classifiers_on_edge_cases(spark, run):
    rng = random.Random(6)
    texts = EDGE + [("you idiot " if i % 3 == 0 else "") + sentence(rng, 20) + (" !!!" * 5 if i % 3 == 0 else "") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(len(EDGE), 99)] + [(10, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = run(docs_of(spark, texts), labels).collect()
    assert len(rows) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    own = {r["doc_id"]: r for r in rows}
    assert own[0]["score"] == own[1]["score"] and own[7]["score"] == own[8]["score"]
    held = [r for r in rows if r["held_out"] and r["doc_id"] >= len(EDGE)]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.9
    assert run(docs_of(spark, []), labels).count() == 0
    assert run(docs_of(spark, texts), labels.limit(0)).count() == len(texts)


def test_quality_fit_is_the_optimum_of_the_linear_hinge_loss():
    """Rows that can't be separated: the dual by projected gradient steps on the whole kernel, and the gap to the primal."""
    rng, n, cost = np.random.default_rng(3), 60, 0.7
    y = np.where(np.arange(n) % 3 == 0, 1.0, -1.0)
    sets = [np.unique(np.r_[rng.integers(0, 40, 12), 40 + (k % 3 == 0) * rng.integers(0, 2)]) for k in range(n)]
    model = quality.fit(sets, (y > 0).astype(int), cost, 1.0, 3000)
    ratio = np.log([(1 + sum(f in s for s, own in zip(sets, y) if own > 0)) / 20 for f in range(42)]) - np.log(
        [(1 + sum(f in s for s, own in zip(sets, y) if own < 0)) / 40 for f in range(42)]
    )
    x = np.zeros((n, 43))
    for k, own in enumerate(sets):
        x[k, own] = ratio[own] / max(1.0, np.linalg.norm(ratio[own]))
    x[:, 42] = 1
    most = cost * np.where(y > 0, n / 40, n / 80)
    kernel = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(60000):
        alpha = np.clip(alpha - step * (kernel @ alpha - 1), 0, most)
    best = alpha @ (y[:, None] * x)
    found = np.r_[model.weights[:42], model.bias]
    primal = lambda w: w @ w / 2 + most @ np.maximum(0, 1 - y * (x @ w))
    assert primal(best) - (alpha.sum() - alpha @ kernel @ alpha / 2) < 1e-3
    assert np.allclose(found, best, atol=1e-3) and abs(primal(found) - primal(best)) < 1e-3
    assert np.sum(alpha == most) > 0 and np.sum((alpha > 0) & (alpha < most)) > 0


@pytest.mark.parametrize("name,column,least", [("op6_quality", "quality", 0.9)])
def test_classifier_held_out_accuracy(spark, sf_dir, name, column, least):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in entry.QUERIES[name](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= least


# 7 ------------------------------------------------------------------------------------------------------------


def brute_components(texts, words=4, num=85, den=100):
    sets = {}
    for i, text in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_matches_brute_force(spark):
    rng = random.Random(7)
    texts = list(EDGE)
    for size in (4, 5, 7, 9, 12, 20, 33, 60, 150, 400):
        for _ in range(4):
            base = sentence(rng, size)
            texts.append(base)
            for _ in range(rng.randrange(6)):
                texts.append(edited(rng, rng.choice(texts[-3:]) or base, rng.randrange(1, 1 + size // 40 + 1)))
            texts.append(base + " " + sentence(rng, max(1, size // 10)))
    rng.shuffle(texts)
    want = brute_components(list(enumerate(texts)))
    rows = ngram_join.jaccard_components(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_ngram_join_large_group_of_variants(spark):
    """A group in which each text is near to some but not to all others, over few words."""
    rng = random.Random(8)
    base = sentence(rng, 100)
    texts = [edited(rng, base, rng.randrange(0, 3)) for _ in range(150)] + [sentence(rng, 100) for _ in range(50)]
    want = brute_components(list(enumerate(texts)))
    rows = ngram_join.jaccard_components(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_ngram_join_ids(spark):
    rows = ngram_join.jaccard_components(docs_of(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A b c d e"), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 3), (1, 1), (3, 3), (5, 3), (5, 3)]
    assert ngram_join.jaccard_components(docs_of(spark, [])).count() == 0


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


# 8 ------------------------------------------------------------------------------------------------------------


def brute_posterior(emission, transition):
    n, k = emission.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = math.exp(sum(emission[i, c] for i, c in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        for i, c in enumerate(path):
            total[i, c] += weight
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("labels", [1, 4, langid.MOST_LABELS + 1])
def test_posteriors_in_pieces_are_those_of_whole_chains(labels):
    rng = np.random.default_rng(labels)
    lengths = np.array([1, 700, 64, 65, 2, 128, 63, 1, 300])
    starts = np.cumsum(lengths) - lengths
    emission, transition = 30 * rng.normal(size=(lengths.sum(), labels)), 2 * rng.normal(size=(labels, labels))
    whole, _ = langid.forward_backward(emission, transition, starts, lengths)
    for size in (1, 7, 64, 1000):
        found = langid.posteriors(emission, transition, starts, lengths, size)
        np.testing.assert_allclose(found, whole, atol=1e-10)
    assert langid.posteriors(emission[:0], transition, starts[:0], lengths[:0]).shape == (0, labels)


def test_one_long_text_takes_few_steps(monkeypatch):
    widths, steps = [], langid._steps
    monkeypatch.setattr(langid, "_steps", lambda *a: widths.append(len(steps(*a)[1]) - 1) or steps(*a))
    field = langid.Field(["a", "b"], np.random.default_rng(1).normal(size=(1 << langid.HASH_BITS, 2)), np.eye(2))
    langid._label(pa.RecordBatch.from_arrays([pa.array(["word " * 20000, "and so on"])], ["text"]), field)
    assert widths == [langid.CHAIN]


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    rows = [(i, f"Plain words {i} {i * 7 % 13} end." if i % 2 else f"zz zz !! {i} %% {i * 5 % 11}") for i in range(120)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    row, feature = quality.features(pa.array([t for _, t in rows]))
    plain = quality.fit([feature[row == i] for i in range(len(rows))], np.array([i % 2 for i, _ in rows]))
    sizes, model_of = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda sets, *a: sizes.append(len(sets)) or model_of(sets, *a))
    model = quality.train(docs, labels, F.lit(True), "quality")
    assert not sizes  # no n-grams came to the driver
    assert np.array_equal(model.weights, plain.weights) and np.array_equal(model.ratio, plain.ratio) and model.bias == plain.bias
    one = quality.train(docs, labels, F.col("id") % 2 == 1, "quality")
    assert one.weights is None and one.bias == 5.0
    assert quality.train(docs, labels, F.lit(False), "quality").bias == 0.0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(10)
    emission, transition = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    starts, lengths = np.array([0, 4, 5]), np.array([4, 1, 4])
    posterior, _ = langid.forward_backward(emission, transition, starts, lengths)
    for s, n in zip(starts, lengths):
        assert np.allclose(posterior[s : s + n], brute_posterior(emission[s : s + n], transition))


def test_language_held_out_accuracy_and_edges(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in entry.op8_language(spark, sf_dir).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows]) > 0.95
    rows = {r["doc_id"]: r for r in langid.classify(docs_of(spark, [*EDGE, "123 456 ..."])).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 9)] == ["und", "und", "und", "en", "en", "und"]
    assert langid.classify(docs_of(spark, [])).count() == 0


def test_language_reads_words_to_their_end_and_chains_across_pieces():
    column = pa.array(["abcdefghijklmnopqrs", "今日はとても良い天気です"])
    data, starts, ends, _ = langid._words(column)
    _, word = langid.word_features(data, starts, ends)
    assert np.bincount(word).tolist() == [7 + 17, 7 + 34]
    tails = ["今日はとても" + x * 6 + "今日はとても" for x in "あんえき"]
    own = langid.fit([x for x in tails for _ in range(8)], [c for c in "aabb" for _ in range(8)])
    posterior, _, _ = langid._label(pa.RecordBatch.from_arrays([pa.array(tails)], ["text"]), own)
    assert posterior.argmax(1).tolist() == [0, 0, 1, 1]
    # words without a feature of their own get their language from a word beyond the 64th
    weights = np.zeros((1 << langid.HASH_BITS, 2))
    only, _ = langid.word_features(*langid._words(pa.array(["zz"]))[:3])
    weights[only] = (0.0, 5.0)
    linked = langid.Field(["a", "b"], weights, np.array([[9.0, 0.0], [0.0, 9.0]]))
    posterior, _, _ = langid._label(pa.RecordBatch.from_arrays([pa.array([" ".join(["q"] * 70 + ["zz"])])], ["text"]), linked)
    assert (posterior[:, 1] > 0.9).all()


def test_code_switched_words():
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "and", "thing", "whing"]) for _ in range(30)) for _ in range(30)]
    texts += [" ".join(rng.choice(["der", "und", "schung", "keit"]) for _ in range(30)) for _ in range(30)]
    field = langid.fit(texts, ["en"] * 30 + ["de"] * 30)
    data, starts, ends, first = langid._words(pa.array(["the thing and whing the der keit und schung der"]))
    posterior, _ = langid.forward_backward(field.emissions(data, starts, ends), field.transitions, *langid.chains(first))
    assert [field.languages[c] for c in posterior.argmax(1)] == ["en"] * 5 + ["de"] * 5


# 9 ------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(12)
    texts = EDGE + [" a  b   c \n\n d's  it's  x   y　 z 12 34 <|endoftext|> e", "é éé 你 好"]
    texts += ["".join(rng.choice("ab .\n\t' é你1") for _ in range(300)) for _ in range(30)]
    rows = packing.pack_documents(docs_of(spark, texts), tokenizer_path()).collect()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert sum(r["length"] for r in own) == len(ids) and (len(own) == 1 or all(r["length"] == 1024 for r in own[1:]))
        assert (len(ids) <= 1024) == (len(own) == 1)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    assert_packed(rows)
    assert packing.pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


def assert_packed(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def brute_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps.remove(fit)
            gaps.append(fit - length)
    return len(gaps)


def test_brackets_match_like_a_stack():
    rng = np.random.default_rng(13)
    for _ in range(200):
        opens, stack, want = rng.random(rng.integers(1, 40)) < 0.5, [], set()
        for i, opening in enumerate(opens):
            if opening:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        assert set(zip(*(a.tolist() for a in packing.brackets(opens)))) == want


@pytest.mark.parametrize("range_rows", [1 << 18, 25])
@pytest.mark.parametrize("low,high,n", [(1, 64, 160), (20, 24, 90), (1, 6, 200)])
def test_packing_is_as_tight_as_sequential_best_fit(spark, low, high, n, range_rows):
    """One range, or many whose left-overs match across them; all pieces come back, once each."""
    rng = random.Random(13)
    lengths = [rng.randrange(low, high + 1) for _ in range(n)]
    rows = spark.createDataFrame([(i, length) for i, length in enumerate(lengths)], "doc_id bigint, length bigint")
    out = packing.pack(rows, 64, range_rows).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == list(enumerate(lengths))
    best = brute_best_fit(lengths, 64)
    assert assert_packed(out, 64) <= best + 1 + best // 50


def test_sweeps_across_ranges_equal_one_sweep(spark):
    """Pieces and slots matched in several ranges and then across them, against brackets over all of them."""
    rng = random.Random(14)
    items = [(rng.random() < 0.5, rng.randrange(1, 50), i) for i in range(150)]
    ordered = sorted(items, key=lambda r: (r[1], r[0], r[2]))
    pieces, slots = packing.brackets(np.array([not slot for slot, _, _ in ordered]))
    want = {(ordered[a][2], ordered[b][2]) for a, b in zip(pieces.tolist(), slots.tolist())}
    frame = spark.createDataFrame(items, "is_slot boolean, size bigint, id bigint")
    swept = stored(packing._swept(frame, 6), "swept")
    found = {(r["id"], r["sequence"]) for r in swept.where("role = 0").collect()}
    across = packing._across(swept)
    rows = across.collect() if across is not None else []
    found |= {(r["id"], r["sequence"]) for r in rows if r["sequence"] is not None}
    assert found == want
    assert {r["id"] for r in rows if r["sequence"] is None} == {i for slot, _, i in items if not slot} - {p for p, _ in want}


# 10 -----------------------------------------------------------------------------------------------------------


def brute_cost(roles):
    """The least cost over all target sequences, by enumeration."""
    best = {chat.START: 0}
    for role in roles:
        following = {}
        for a, cost in best.items():
            for before, after, more, _ in chat.steps(role):
                if before == a:
                    following[after] = min(following.get(after, chat.INF), cost + more)
        best = following
    return min(c + chat.ENDING[s] for s, c in best.items())


def test_chat_repair_over_partitions(spark):
    rng = random.Random(14)
    rows = []
    for conv in range(40):
        n = 300 if conv == 7 else rng.randrange(1, 9)
        for turn in range(n):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["hi", "", None, "a <|im_end|> b"]), 1))
    rows += [(None, None, None, None, 1), (None, None, "user", "x", 1), (99, 1, "user", "x", 1), (99, 1, "user", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos int")
    got = sorted(chat.format_turns(turns).collect(), key=lambda r: (r["part"], r["pos"]))
    assert len(got) == len(rows)
    by, raw = {}, {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    for r in sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in (r[0], r[1], r[2] or "", r[3] or ""))):
        raw.setdefault(r[0], []).append(r)
    for conv, own in by.items():
        text = "".join(r["rendered"] for r in own)
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert text.count(chat.CLOSE) == len(roles) and text.endswith(chat.CLOSE + "\n")
        assert roles[-1] == "assistant" and "system" not in roles[1:]
        body = roles[1:] if roles[0] == "system" else roles
        assert all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body))
        cost = 0
        for r in own:
            known = r["role"] in chat.ROLES
            cost += (chat.RELABEL if known else chat.RELABEL // 2) * ("relabel" in r["action"]) + chat.MERGE * ("merge" in r["action"])
            cost += chat.INSERT * (len(r["inserted_before"]) + len(r["inserted_after"]))
        assert cost == brute_cost([r["role"] for r in own])
    assert chat.format_turns(turns.limit(0)).count() == 0
