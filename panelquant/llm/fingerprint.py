"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a non-empty line) is hashed to a wide vector; a text's fingerprint
is the sum of its paragraphs' vectors, lane by lane, modulo powers of two. The
sum ignores order, and a paragraph can be inserted or deleted by adding or
subtracting its vector alone. A vector has two parts:

* ``EXACT_LANES`` lanes modulo 2**32 from an extendable hash of the paragraph's
  bytes. They decide equality: unlike multisets agree with a chance of 2**-1024.
* ``SKETCH_LANES`` lanes modulo 2**16 that hold signed counts of the word-start
  windows inside the paragraph. They are linear too, and the cosine of two such
  parts estimates how alike the texts are.

Cases: a null text counts as empty; an empty text has the zero fingerprint; two
empty texts are alike (1.0), an empty and another text are not (0.0); repeated
paragraphs count as often as they occur; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

EXACT_LANES, SKETCH_LANES, WINDOW = 32, 128, 16


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The exact (uint32) and sketch (uint16) lanes of each text, one row a text."""
    data, offsets = T.utf8(texts)
    starts, ends, first = T.spans(data, offsets, T.NEWLINE)
    exact = np.zeros((len(texts), EXACT_LANES), np.uint32)
    if len(starts):
        raw = data.tobytes()
        own = b"".join(
            hashlib.shake_128(raw[s:e]).digest(4 * EXACT_LANES) for s, e in zip(starts.tolist(), ends.tolist())
        )
        lanes = np.frombuffer(own, "<u4").reshape(-1, EXACT_LANES)
        some = np.flatnonzero(np.diff(first))
        exact[some] = np.add.reduceat(lanes, first[some], axis=0, dtype=np.uint32)
    word, _, word_first = T.spans(data, offsets, T.BLANK)
    sketch = np.zeros((len(texts), SKETCH_LANES), np.int64)
    if len(word):
        left = ends[np.searchsorted(starts, word, "right") - 1] - word
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        low = eight[word] & mask[np.minimum(left, 8)]
        high = eight[word + 8] & mask[np.clip(left - 8, 0, 8)]
        window = T.mix(low ^ T.mix(high + np.uint64(1)))
        lane = (window % np.uint64(SKETCH_LANES)).astype(np.int64)
        sign = 1.0 - 2.0 * (window >> np.uint64(63)).astype(np.float64)
        cell = T.row_of(word_first) * SKETCH_LANES + lane
        sketch = np.bincount(cell, sign, len(texts) * SKETCH_LANES).astype(np.int64).reshape(-1, SKETCH_LANES)
    return exact, (sketch & 0xFFFF).astype(np.uint16)


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as hex strings."""
    both = np.concatenate([exact.astype("<u4").view(np.uint8), sketch.astype("<u2").view(np.uint8)], axis=1)
    return [row.tobytes().hex() for row in both]


def decode(fingerprints: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(-1, 4 * EXACT_LANES + 2 * SKETCH_LANES)
    cut = 4 * EXACT_LANES
    return raw[:, :cut].copy().view("<u4"), raw[:, cut:].copy().view("<u2")


def insert(fingerprint: str, text: str, times: int = 1) -> str:
    """The fingerprint after ``text``'s paragraphs were added ``times`` times (negative: deleted)."""
    exact, sketch = decode([fingerprint])
    more_exact, more_sketch = vectors(pa.array([text]))
    exact = exact + more_exact * np.uint32(times % 2**32)
    return encode(exact, sketch + more_sketch * np.uint16(times % 2**16))[0]


def delete(fingerprint: str, text: str) -> str:
    return insert(fingerprint, text, -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1, row by row: 1 for equal fingerprints, else the cosine of the centred sketches."""
    x, y = a[1].view(np.int16).astype(np.float64), b[1].view(np.int16).astype(np.float64)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0 - 1e-9))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            yield pa.record_batch([batch.column("id"), pa.array(encode(*vectors(batch.column("text"))))], ["id", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, f string")
    return out.select(F.col("id").alias(id_col), F.col("f").alias("fingerprint"))


def _ordered(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows (bucket, tail, id, text) sorted by descending id; a bucket ends with its successor's first row as tail.

    Buckets are ranges of ids of about ``bucket_rows`` rows. The ids' quantiles
    and the buckets' largest ids go to the driver: a few numbers for each bucket.
    """
    rows = docs.count()
    n = max(1, rows // bucket_rows)
    cuts = docs.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 100 * n)).first()[0] if n > 1 else []
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(splits) > 2:
        model = Bucketizer(splits=splits, inputCol="as_double", outputCol="b", handleInvalid="keep")
        placed = model.transform(docs.withColumn("as_double", F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))))
        placed = placed.select(F.col("b").cast("int").alias("bucket"), "id", "text")
    else:
        placed = docs.select(F.lit(0).alias("bucket"), "id", "text")
    heads = sorted(((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.max("id")).collect()), reverse=True)
    if not heads:
        return placed.select("bucket", F.lit(0).alias("tail"), "id", "text")
    receivers = [(heads[i - 1][0], *head) for i, head in enumerate(heads)]  # the last bucket's successor is the first
    tails = docs.sparkSession.createDataFrame(receivers, "to int, own int, head bigint")
    tails = placed.join(F.broadcast(tails), (placed["bucket"] == tails["own"]) & placed["id"].eqNullSafe(tails["head"]))
    tails = tails.groupBy("to", "id").agg(F.min("text").alias("text"))
    both = placed.select("bucket", F.lit(0).alias("tail"), "id", "text").unionByName(
        tails.select(F.col("to").alias("bucket"), F.lit(1).alias("tail"), "id", "text")
    )
    tasks = max(1, min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return both.repartition(tasks, "bucket").sortWithinPartitions(
        F.desc("bucket"), "tail", F.desc_nulls_last("id"), F.asc_nulls_last("text")
    )


def fingerprint_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1000
) -> DataFrame:
    """Fingerprint every text and the text made from it and its successor; see ``op1`` for the columns.

    The successor is the next row in descending id (the first row follows the
    last; rows with equal ids follow in text order, null ids come last). The
    edited text has its last third replaced by as much of the successor's start.
    Texts are shuffled once, by ranges of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the last row seen, whose successor is still to come
        for batch in T.blocks(batches, "text"):
            rows = held + list(
                zip(
                    batch.column("bucket").to_pylist(),
                    batch.column("tail").to_pylist(),
                    batch.column("id").to_pylist(),
                    [t or "" for t in batch.column("text").to_pylist()],
                )
            )
            held = rows[-1:]
            if len(rows) < 2:
                continue
            texts = [r[3] for r in rows]
            edited = []
            for text, following in zip(texts, texts[1:]):
                k = len(text) // 3
                edited.append(text[: len(text) - k] + following[:k])
            own = vectors(pa.array(texts, pa.large_string()))
            other = vectors(pa.array(edited, pa.large_string()))
            here, after = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
            out = pa.table(
                {
                    "id": pa.array([r[2] for r in rows[:-1]], pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                    "fingerprint": encode(*here),
                    "edited_fingerprint": encode(*other),
                    "near_edited": likeness(here, other),
                    "near_next": likeness(here, after),
                }
            )
            yield from out.filter(pa.array([r[1] == 0 for r in rows[:-1]])).to_batches()

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = _ordered(named, bucket_rows).mapInArrow(
        run,
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return out.withColumnRenamed("id", id_col)
