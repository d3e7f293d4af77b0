"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, other)
through a small fixed lexicon and stems learned from labelled rows. Five small
transducers read a clause's symbols: insult, threat, target, negation and
reported speech. They are composed into one deterministic transducer whose
output says, for each insult or threat, under which of the others it stands. A
clause's matched patterns, not its isolated words, are counted, and a logistic
model fitted on labelled rows weighs the patterns.

Cases: null and empty texts match nothing and get the score of the bias alone;
without labelled rows of both classes every pattern's weight is 0 and the score
is the share of label 1 (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .labelled import held_out, labelled_sample

#: Labelled rows that stems and weights are learned from, at most.
SAMPLE_ROWS = 8000
#: Bytes of the stems that may be learned; 0 is the whole word.
STEM_BYTES = (0, 4, 5, 6, 7)
#: A stem is learned from so many toxic rows at least, and so much more often (log) than in others.
MIN_ROWS, MIN_LOG_ODDS = 4, 3.0
MAX_STEMS = 4000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: The fixed lexicon.
LEXICON = {
    INSULT: "idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb fool imbecile jerk vermin filth pig coward liar",
    THREAT: "kill hurt destroy punish burn beat crush smash attack shoot stab hang",
    TARGET: "you your yours youre he him his she her they them their these those people everyone u",
    NEGATION: "not no never none neither nor nobody isnt arent wasnt dont doesnt didnt wont cannot without kein nicht nie pas jamais nunca",
    REPORT: "said says say told tells quoted quote wrote writes called reported reports claimed claims sagte dit dijo",
}

#: Ends of clauses.
_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".,;:!?\n|()\"")] = True

# A transducer: its first state, and (state, symbol) -> (next state, output bit); other symbols keep the state and put out 0.
_INSULT = (0, {(0, INSULT): (0, 1)})
_THREAT = (0, {(0, THREAT): (0, 1)})
_TARGET = (0, {(0, TARGET): (1, 0), (1, INSULT): (1, 1), (1, THREAT): (1, 1)})
_NEGATION = (
    0,
    {(0, NEGATION): (3, 0)}
    | {(k, s): (k - 1, int(s in (INSULT, THREAT))) for k in (1, 2, 3) for s in (OTHER, INSULT, THREAT, TARGET, REPORT)}
    | {(k, NEGATION): (0, 0) for k in (1, 2, 3)},
)
_REPORTED = (0, {(0, REPORT): (1, 0), (1, INSULT): (1, 1), (1, THREAT): (1, 1)})
TRANSDUCERS = (_INSULT, _THREAT, _TARGET, _NEGATION, _REPORTED)
#: Patterns: which of the five put out a 1 at an insult or a threat.
PATTERNS = [p for p in product((0, 1), repeat=5) if p[0] + p[1] == 1]


def compose(machines=TRANSDUCERS) -> tuple[int, dict[tuple[int, int], tuple[int, tuple[int, ...]]]]:
    """The product of transducers that read the same symbols: one machine, its output all their bits."""
    first = tuple(m[0] for m in machines)
    number, todo, table = {first: 0}, [first], {}
    while todo:
        state = todo.pop()
        for symbol in range(6):
            moves = [m[1].get((s, symbol), (s, 0)) for m, s in zip(machines, state)]
            following = tuple(s for s, _ in moves)
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            table[number[state], symbol] = (number[following], tuple(bit for _, bit in moves))
    return number[first], table


START_STATE, TABLE = compose()
_PATTERN_NUMBER = {p: i for i, p in enumerate(PATTERNS)}


def _keys(column: pa.Array):
    """Word starts and first of each row, clause of each word, and hashes of each word's stems (a row for each of STEM_BYTES)."""
    data, offsets = T.utf8(column)
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offsets, T.NOT_ALNUM)
    clause = np.concatenate([[0], np.cumsum(_CLAUSE[data])])[starts] if len(data) else np.zeros(0, np.int64)
    stems = []
    for size in STEM_BYTES:
        stop = ends if size == 0 else np.minimum(starts + size, ends)
        own = T.hashes(data, starts, stop) if len(data) else np.zeros(0, np.uint64)
        stems.append(T.mix(own + np.uint64(size)))
    return first, clause, np.stack(stems)


def _fixed() -> dict[int, int]:
    """Hash of each word of the lexicon to its symbol."""
    out = {}
    for symbol, text in LEXICON.items():
        _, _, stems = _keys(pa.array([text]))
        out |= dict.fromkeys(stems[0].tolist(), symbol)
    return out


def symbols(stems: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each word's symbol: that of its first stem in the lexicon (sorted ``keys``)."""
    out = np.zeros(stems.shape[1], np.int8)
    if not len(keys):
        return out
    for own in stems:
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out = np.where((out == 0) & (keys[at] == own), values[at], out)
    return out


def clauses(column: pa.Array, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(row, first word, end, pattern counts) of the clauses in which a pattern matches."""
    first, clause, stems = _keys(column)
    symbol = symbols(stems, keys, values)
    row = T.row_of(first)
    hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    out, done = [], -1
    for at in hot.tolist():
        if at < done:
            continue
        r, own = row[at], clause[at]
        low, high = first[r], first[r + 1]
        begin = low + np.searchsorted(clause[low:high], own, "left")
        done = low + np.searchsorted(clause[low:high], own, "right")
        counts, state = np.zeros(len(PATTERNS)), START_STATE
        for s in symbol[begin:done].tolist():
            state, bits = TABLE[state, s]
            if s in (INSULT, THREAT):
                counts[_PATTERN_NUMBER[bits]] += 1
        out.append((int(r), int(begin - low), int(done - low), counts))
    return out


def pattern_features(column: pa.Array, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row, log counts of clauses by pattern, whether any matched, and their share of the words."""
    first, _, _ = _keys(column)
    n = len(column)
    total = np.zeros((n, len(PATTERNS)))
    for r, _, _, counts in clauses(column, keys, values):
        total[r] += np.minimum(counts, 1)
    every = total.sum(1)
    share = every / np.maximum(np.diff(first), 1)
    return np.concatenate([np.log1p(total), (every > 0)[:, None], (every > 1)[:, None], np.minimum(20 * share, 1)[:, None]], axis=1)


@dataclass
class Model:
    keys: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = pattern_features(texts, self.keys, self.values) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + penalty * w
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn_stems(sample: DataFrame) -> list[int]:
    """Hashes of the stems that mark toxic rows of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            first, _, stems = _keys(batch.column("text"))
            row = np.tile(T.row_of(first), len(STEM_BYTES))
            stem, row = T.distinct(stems.reshape(-1), row)
            label = batch.column("label").to_numpy()[row]
            yield pa.record_batch([T.array(stem), pa.array(label.astype(np.int64))], ["stem", "label"])

    totals = sample.groupBy("label").count().collect()
    ones, zeros = (next((r[1] for r in totals if r[0] == k), 0) for k in (1, 0))
    if not ones or not zeros:
        return []
    found = sample.select("label", "text").mapInArrow(run, "stem bigint, label bigint")
    found = found.groupBy("stem").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where(F.col("a") >= MIN_ROWS)
    odds = F.ln((F.col("a") + 0.1) / ones) - F.ln((F.col("n") - F.col("a") + 0.1) / zeros)
    best = found.withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    return [r["stem"] % 2**64 for r in best.orderBy(F.desc("a"), "stem").limit(MAX_STEMS).collect()]


def train(docs: DataFrame, labels: DataFrame, where: Column, label_col="toxic", id_col="doc_id", text_col="text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn stems and weights from at most ``sample_rows`` labelled rows for which ``where`` (on ``id``) holds."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, where, sample_rows)
    lexicon = dict.fromkeys(learn_stems(sample), INSULT) | _fixed()
    keys = np.array(sorted(lexicon), np.uint64)
    values = np.array([lexicon[k] for k in keys.tolist()], np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            x = pattern_features(batch.column("text"), keys, values)
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    rows = sample.select("id", "label", "text").mapInArrow(run, "id bigint, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(PATTERNS) + 3)
    weights, bias = fit_logistic(x, np.array([r["label"] for r in rows], float))
    return Model(keys, values, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, clauses) of every row; clauses: (first word, end word) of the matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            p = model.scores(batch.column("text"))
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for r, begin, end, _ in clauses(batch.column("text"), model.keys, model.values):
                spans[r].append({"begin": begin, "end": end})
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch(
                [batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                ["id", "score", "predicted", "clauses"],
            )

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, score double, predicted int, clauses array<struct<begin:int,end:int>>"
    return named.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, n_clauses): labels of the fold aren't learned."""
    model = train(docs, labels, ~held_out(F.col("id"), folds, fold), "toxic", id_col, text_col)
    out = score(docs, model, id_col, text_col)
    marked = held_out(F.col(id_col), folds, fold)
    return out.select(id_col, marked.alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))
