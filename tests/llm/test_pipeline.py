"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from panelquant.llm import components, counters
from panelquant.llm.scratch import stored
from tests.llm.test_operators import brute_components, brute_lines, docs_of, sentence


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    read = lambda df: {r["doc_id"]: r for r in df.collect()}
    before = read(docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if k == 4:
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert out.columns == columns
        after = read(out)
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if k == 0:
            right = [labels[i] == (i in after) for i in before if i in labels]
            assert sum(right) / len(right) > 0.9
        elif k == 1:
            ids = sorted(before)
            dropped = brute_lines([before[i]["text"] for i in ids])
            for n, i in enumerate(ids):
                lines = before[i]["text"].split("\n")
                kept = "\n".join(x for j, x in enumerate(lines) if (n, j) not in dropped)
                assert after[i]["text"] == kept if i in after else not kept.strip()
        elif k == 2:
            found = brute_components([(i, r["text"]) for i, r in before.items()])
            assert gone == {i for i, (_, c) in found.items() if c != i}
        elif k == 3:
            assert all(after[i] == before[i] for i in after)
        docs, before = out, after
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_near_duplicates_by_five_words(spark, sf_dir):
    """Pairs that link by five words and 0.8 but not by four words and 0.85: two changed words, and a block put in."""
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        words = sentence(rng, 96, 10**6).split(" ")
        changed = [f"z{k}" if k in (30, 60) else x for k, x in enumerate(words)]
        longer = words[:40] + sentence(rng, 12, 10**6).split(" ") + words[40:]
        beyond = [f"y{k}" if k in (20, 45, 70) else x for k, x in enumerate(words)]
        texts += [" ".join(x) for x in (words, changed, longer, beyond)]
    pairs = list(enumerate(texts))
    want = {i for i, (_, c) in brute_components(pairs, words=5, num=80).items() if c == i}
    assert want == {i for i in range(16) if i % 4 in (0, 3)}
    assert all(c == i for i, (_, c) in brute_components(pairs).items())
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == want


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls, repeated rows, clashing columns and an empty table, in the stages that tell rows apart by a key."""
    text = sentence(random.Random(5), 40)
    rows = [(1, text), (1, text), (1, "another text under this id"), (None, text), (None, None), (None, None), (2, None), (3, ""), (4, sentence(random.Random(6), 3000))]
    docs = docs_of(spark, rows)
    for name in ("__key", "own_key", "key", "component_id", "keeper", "shard", "hits"):
        docs = docs.withColumn(name, docs["doc_id"])
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted({(1, text), (1, "another text under this id"), (None, None), (2, None), (3, ""), rows[-1]}, key=str)
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    more = docs.unionByName(docs_of(spark, [(9, f"before {leak} after")]), allowMissingColumns=True)
    clean = corpus_pipeline.decontamination(spark, more, sf_dir)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(rows, key=str)
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), sf_dir).count() == 0


def jobs_of(spark, group, run):
    """What ``run`` gives, and how many jobs it takes."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, len(context.statusTracker().getJobIdsForGroup(group))


def test_corpus_counts_take_few_jobs_over_many_partitions(spark):
    rows = []
    for task in range(3):
        counts = counters.Counts()
        counts.add(np.arange(1 << 10, dtype=np.uint64) << np.uint64(54))
        counts.add(np.zeros(task, np.uint64))
        rows += [(block, bytearray(cells)) for block, cells in counts.blocks()]
    blocks = spark.createDataFrame(rows, "block bigint, cells binary")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        table, jobs = jobs_of(spark, "merged", lambda: counters.merged(blocks))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = np.zeros(1 << counters.COUNTER_BITS)
    want[:: 1 << counters.COUNTER_BITS - 10] = 3
    want[0] += 0 + 1 + 2
    assert (table == np.minimum(8 * np.log2(1 + want), 254).astype(np.uint8)).all()
    assert jobs <= 4


def test_links_that_are_stars_take_no_step(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or stored(df, name))

    def found(edges):
        written.clear()
        rows = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
        out = {r["node"]: r["component"] for r in rows}
        assert len(out) == len(rows)
        return out, len(written)

    assert found([(1, k) for k in range(2, 30)] + [(40, 31), (31, 50)] * 2 + [(7, 7)]) == ({k: 1 for k in range(1, 30)} | {31: 31, 40: 31, 50: 31}, 1)
    # a node with two links, and one that is another's other, are no stars
    assert found([(9, 3), (9, 5)])[0] == {3: 3, 5: 3, 9: 3}
    assert found([(9, 5), (5, 3)])[0] == {3: 3, 5: 3, 9: 3}
    assert found([(7, 7)]) == ({}, 1)
