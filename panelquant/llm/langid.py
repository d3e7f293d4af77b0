"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed: the word itself (a learned lexicon), prefixes and
suffixes of one to three bytes, and the byte trigrams at all its positions. The field has a weight for each
(feature, language), and learned transitions between the languages of neighbouring
words; forward-backward gives each word's language probabilities, so text that
switches languages is labelled word by word. A text's language is the one with the
largest total probability over its words.

The field is fitted on a bounded sample of whole documents (every word bears its
document's language); scoring reads every text once and shuffles nothing.

Cases: a text that is null or has no letter is ``und`` with score 0; rows without
language are not learned from; without any labelled row every text is ``und``;
repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .labelled import held_out

HASH_BITS = 18
#: Documents of each language that the field is fitted on, at most.
SAMPLE_ROWS = 300
#: Words of a chain in fitting, where longer texts are several chains; in scoring each text is one.
CHAIN = 64
#: Labels up to which scoring cuts chains into pieces.
MOST_LABELS = 16
EPOCHS, RATE, RIDGE = 6, 0.3, 1e-4
UNKNOWN = "und"

#: Words here are runs of letters: bytes of a-z and of characters outside ASCII.
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word): the hashed features of each word; ``total`` as of :func:`textops.hash_sums`."""
    total = T.hash_sums(data) if total is None else total
    words = np.arange(len(starts))
    kinds = [(starts, ends, words, 0)]
    for k in (1, 2, 3):
        kinds += [(starts, np.minimum(starts + k, ends), words, 2 * k - 1), (np.maximum(ends - k, starts), ends, words, 2 * k)]
    count = np.maximum(ends - starts - 2, 0)
    of = np.repeat(words, count)
    at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    kinds.append((at, at + 3, of, 7))  # trigrams share their weights wherever they stand
    mask = np.uint64((1 << HASH_BITS) - 1)
    feature = [(T.mix(T.hashes(data, a, b, total) + np.uint64(kind)) & mask).astype(np.int64) for a, b, _, kind in kinds]
    return np.concatenate(feature), np.concatenate([of for _, _, of, _ in kinds])


def _summed(weights: np.ndarray, feature: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """n x languages: the weights of each word's features, added up."""
    return np.stack([np.bincount(word, weights[feature, c], n) for c in range(weights.shape[1])], axis=1)


def _words(column: pa.Array):
    data, offsets = T.utf8(column)
    data = T.LOWER[data]
    return data, *T.spans(data, offsets, _NOT_LETTER)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # 2 ** HASH_BITS x languages
    transitions: np.ndarray  # languages x languages

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """words x languages: summed weights, computed once for each distinct word."""
        if not len(starts):
            return np.zeros((0, len(self.languages)))
        total = T.hash_sums(data)
        _, at, which = np.unique(T.hashes(data, starts, ends, total), return_index=True, return_inverse=True)
        return _summed(self.weights, *word_features(data, starts[at], ends[at], total), len(at))[which]


def chains(first: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of at most ``size`` words of each row."""
    counts = np.diff(first)
    pieces = -(-counts // size)
    row = np.repeat(np.arange(len(counts)), pieces)
    within = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[:-1][row] + within * size
    return starts, np.minimum(counts[row] - within * size, size)


def forward_backward(emission: np.ndarray, transition: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(posterior of each word, expected transitions): all chains step by step together."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels = emission.shape[1]
    move = np.exp(transition - transition.max())
    local = np.exp(emission - emission.max(1, keepdims=True))
    steps = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # chains longer than t come first
    alpha = np.zeros_like(emission)
    for t in range(steps):
        k = active[t]
        own = local[starts[:k] + t]
        a = own if t == 0 else (alpha[starts[:k] + t - 1] @ move) * own
        alpha[starts[:k] + t] = a / a.sum(1, keepdims=True)
    posterior = np.zeros_like(emission)
    expected = np.zeros((labels, labels))
    beta = np.ones((len(starts), labels))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        p = alpha[starts[:k] + t] * beta[:k]
        posterior[starts[:k] + t] = p / p.sum(1, keepdims=True)
        if t:
            ahead = local[starts[:k] + t] * beta[:k]
            joint = np.einsum("ni,nj->nij", alpha[starts[:k] + t - 1], ahead) * move
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = ahead @ move.T
            beta[:k] = b / b.sum(1, keepdims=True)
    return posterior, expected


def _steps(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, cut): the t-th words of all chains, which come longest first, for one t after another; cut[t] is where they begin."""
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    cut = np.concatenate([[0], np.cumsum(active)])
    t = np.repeat(np.arange(len(active)), active)
    return starts[np.arange(cut[-1]) - cut[t]] + t, cut


def posteriors(emission: np.ndarray, transition: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int = CHAIN) -> np.ndarray:
    """The posteriors of :func:`forward_backward`, in a number of steps that hardly depends on the longest chain.

    Chains are cut into pieces of ``size`` words. A piece passes messages on by a matrix, the product of its
    words' steps. The matrices of all pieces are multiplied side by side, messages go from piece to piece through them, and
    the pieces' words get theirs side by side again. Matrices cost a factor of the number of labels, so with many, chains stay whole.
    """
    n, labels = emission.shape
    if not len(starts) or not n:
        return np.zeros_like(emission)
    move = np.exp(transition - transition.max())
    size = size if labels <= MOST_LABELS else max(1, int(lengths.max()))
    pieces = -(-lengths // size)
    chain = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, length = starts[chain] + nth * size, np.minimum(lengths[chain] - nth * size, size)
    last = nth == pieces[chain] - 1
    order = np.lexsort((last, -length))
    chain, nth, begin, length, last = (x[order] for x in (chain, nth, begin, length, last))
    first, many = nth == 0, len(chain)
    word, cut = _steps(begin, length)
    steps = len(cut) - 1
    local = np.exp(emission - emission.max(1, keepdims=True)).T[:, word]  # labels x words, step by step

    # messages at the pieces' borders
    ahead, behind = np.ones((labels, many)), np.ones((labels, many))
    if not (first & last).all():
        product = np.repeat(np.eye(labels)[:, :, None], many, axis=2)
        for t in range(steps):
            k = cut[t + 1] - cut[t]
            own = product[:, :, :k]
            moved = np.matmul(move.T, own)
            if t == 0:
                moved[:, :, first[:k]] = own[:, :, first[:k]]
            moved *= local[:, cut[t] : cut[t + 1]]
            product[:, :, :k] = moved / moved.sum((0, 1))
        rank = np.argsort(order)  # of the pieces in the order of chains
        head = np.cumsum(pieces) - pieces
        for j in range(1, int(pieces.max())):
            far = pieces > j
            here, before = rank[head[far] + j], rank[head[far] + j - 1]
            a = np.einsum("ip,ilp->lp", ahead[:, before], product[:, :, before])
            ahead[:, here] = a / a.sum(0)
            at, after = rank[(head + pieces)[far] - 1 - j], rank[(head + pieces)[far] - j]
            b = np.einsum("ilp,lp->ip", product[:, :, after], behind[:, after])
            behind[:, at] = b / b.sum(0)

    alpha = np.empty_like(local)
    for t in range(steps):
        k = cut[t + 1] - cut[t]
        if t:
            a = move.T @ alpha[:, cut[t - 1] : cut[t - 1] + k]
        else:
            a = np.where(first, 1.0, move.T @ ahead)
        a *= local[:, cut[t] : cut[t + 1]]
        a /= a.sum(0)
        alpha[:, cut[t] : cut[t + 1]] = a
    beta = behind
    for t in range(steps - 1, -1, -1):
        k = cut[t + 1] - cut[t]
        own = slice(cut[t], cut[t + 1])
        alpha[:, own] *= beta[:, :k]
        if t:
            b = move @ (local[:, own] * beta[:, :k])
            beta[:, :k] = b / b.sum(0)
    alpha /= alpha.sum(0)
    posterior = np.zeros_like(emission)
    posterior[word] = alpha.T
    return posterior


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Field:
    """Maximise the field's likelihood by AdaGrad over blocks of documents."""
    languages = sorted(set(labels))
    n = len(languages)
    field = Field(languages, np.zeros((1 << HASH_BITS, n)), np.zeros((n, n)))
    square, square_moves = np.full_like(field.weights, 1e-8), np.full((n, n), 1e-8)
    number = {x: i for i, x in enumerate(languages)}
    order = np.random.default_rng(11).permutation(len(texts))
    blocks = []
    for part in np.array_split(order, max(1, len(order) // 32)):
        data, starts, ends, first = _words(pa.array([texts[i] for i in part], pa.large_string()))
        if len(starts):
            truth = np.array([number[labels[i]] for i in part])[T.row_of(first)]
            blocks.append((*word_features(data, starts, ends), truth, *chains(first)))
    for _ in range(epochs):
        for feature, word, truth, starts, lengths in blocks:
            emission = _summed(field.weights, feature, word, len(truth))
            posterior, expected = forward_backward(emission, field.transitions, starts, lengths)
            delta = -posterior
            delta[np.arange(len(truth)), truth] += 1
            slots, place = np.unique(feature, return_inverse=True)
            gradient = _summed(delta, word, place, len(slots))
            gradient -= RIDGE * len(truth) * field.weights[slots]
            square[slots] += gradient**2
            field.weights[slots] += RATE * gradient / np.sqrt(square[slots])
            observed = np.zeros((n, n))
            inner = np.setdiff1d(np.arange(len(truth)), starts)
            np.add.at(observed, (truth[inner - 1], truth[inner]), 1)
            moved = observed - expected - RIDGE * len(truth) * field.transitions
            square_moves += moved**2
            field.transitions += RATE * moved / np.sqrt(square_moves)
    return Field(languages, field.weights.astype(np.float32), field.transitions)


def train(docs: DataFrame, where: Column, id_col="doc_id", text_col="text", lang_col="lang", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on at most ``sample_rows`` whole documents of each language, those with the smallest hash of their id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null and id is not null").where(where)
    names = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    ids = None
    for name in names:
        own = rows.where(F.col("lang") == name).select("id", "lang").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        ids = own if ids is None else ids.unionByName(own)
    if ids is None:
        return Field([], np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros((0, 0)))
    sample = rows.join(F.broadcast(ids.distinct()), ["id", "lang"]).select("id", "lang", "text").collect()
    sample.sort(key=lambda r: (r["id"], r["lang"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _label(batch: pa.RecordBatch, field: Field):
    column = batch.column("text")
    data, starts, ends, first = _words(column)
    whole = chains(first, max(1, int(np.diff(first).max(initial=0))))  # a text is one chain
    posterior = posteriors(field.emissions(data, starts, ends), field.transitions, *whole)
    ascii_letter = ~_NOT_LETTER.copy()
    ascii_letter[128:] = False
    _, offsets = T.utf8(column)
    plain = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    letter = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~letter).tolist():
        letter[i] = _has_letter(column[i].as_py())
    return posterior, first, letter


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; score is the language's share of the words' probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            n = batch.num_rows
            if not field.languages:
                yield pa.record_batch([batch.column("id"), pa.array([UNKNOWN] * n), pa.array(np.zeros(n))], ["id", "lang_pred", "score"])
                continue
            posterior, first, letter = _label(batch, field)
            row = T.row_of(first)
            total = np.stack([np.bincount(row, posterior[:, c], n) for c in range(len(field.languages))], axis=1)
            best = total.argmax(1)
            share = total[np.arange(n), best] / np.maximum(total.sum(1), 1e-300)
            known = letter & (total.sum(1) > 0)
            names = [field.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            yield pa.record_batch([batch.column("id"), pa.array(names), pa.array(np.where(known, share, 0.0))], ["id", "lang_pred", "score"])

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, begin, end): the stretches of words of one language in each text, as word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            if not field.languages:
                continue
            posterior, first, _ = _label(batch, field)
            if not len(posterior):
                continue
            best, row = posterior.argmax(1), T.row_of(first)
            new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
            end = np.append(new[1:], len(best))
            base = first[:-1][row[new]]
            yield pa.record_batch(
                [
                    batch.column("id").take(pa.array(row[new])),
                    pa.array([field.languages[b] for b in best[new].tolist()]),
                    pa.array((new - base).astype(np.int32)),
                    pa.array((end - base).astype(np.int32)),
                ],
                ["id", "lang", "begin", "end"],
            )

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id bigint, lang string, begin int, end int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): languages of the fold aren't learned."""
    field = train(docs, ~held_out(F.col("id"), folds, fold), id_col, text_col, lang_col)
    out = identify(docs, field, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "lang_pred", "score")
