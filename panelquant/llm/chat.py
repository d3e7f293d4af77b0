"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton.

A legal conversation has at most one system message, at its start, and then user
and assistant messages in turn, from a user to an assistant. Every turn keeps or
changes its role (``RELABEL``), goes to a message of its own or into the message
before it (``MERGE``), and empty messages may be put in between (``INSERT`` each);
the cheapest legal reading of the whole conversation is chosen and rendered.

The program's step for a turn is a small matrix of costs between automaton
states, so a stretch of turns is the min-plus product of its matrices.
Conversations are range-sorted over the cluster; one that spans several parts
meets at their borders through two such products for each part, and no task
holds more than a part, however long a conversation is.

Cases: turns are ordered by (turn, role, text), nulls first; a null or unknown
role always pays ``RELABEL`` at half price; a null text is empty; rows without
conversation id form one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 2, 3, 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
INF = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest sequences of empty messages that make a new message of state b legal after state a."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for a in NEXT:
        reached = {a: ()}
        for _ in NEXT:
            for state, path in list(reached.items()):
                for b in NEXT[state]:
                    if (a, b) not in out or len(path) < len(out[a, b]):
                        out[a, b] = path
                    if b not in reached:
                        reached[b] = (*path, b)
    return out


PATHS = _paths()


def steps(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(state before, state after, cost, merged) of the ways to read a turn, merging last."""
    known = role in ROLES
    out = []
    for b, name in enumerate(ROLES, 1):
        change = 0 if name == role else RELABEL if known else RELABEL // 2
        out += [(a, b, change + INSERT * len(PATHS[a, b]), False) for a in NEXT if (a, b) in PATHS]
        out.append((b, b, change + MERGE, True))
    return out


STEPS = {role: steps(role) for role in (*ROLES, None)}
#: Cost of ending in each state: the empty messages up to an assistant's.
ENDING = [0, 2 * INSERT, INSERT, 0]


def _steps(role: str | None) -> list[tuple[int, int, int, bool]]:
    return STEPS[role if role in ROLES else None]


def forward(costs: list[int], role: str | None) -> list[int]:
    out = [INF] * 4
    for a, b, cost, _ in _steps(role):
        out[b] = min(out[b], costs[a] + cost)
    return out


def matrix(roles: list[str | None]) -> list[list[int]]:
    """Costs from each state before the turns to each state after them."""
    rows = [[0 if a == b else INF for b in range(4)] for a in range(4)]
    for role in roles:
        rows = [forward(row, role) for row in rows]
    return rows


def repair(roles: list[str | None], entry: list[int], exit_state: int | None) -> list[tuple[int, int, bool]]:
    """(state before, state after, merged) of each turn on the cheapest path; ``exit_state`` None: any legal end."""
    costs = [entry]
    for role in roles:
        costs.append(forward(costs[-1], role))
    state = exit_state
    if state is None:
        state = min(range(4), key=lambda s: costs[-1][s] + ENDING[s])
    out = []
    for i in range(len(roles) - 1, -1, -1):
        a, merged = next((a, m) for a, b, c, m in _steps(roles[i]) if b == state and costs[i][a] + c == costs[i + 1][state])
        out.append((a, state, merged))
        state = a
    return out[::-1]


def _message(role: str, text: str = "") -> str:
    return f"{OPEN}{role}\n{text}"


def rendered(roles, texts, path, last: bool) -> list[dict]:
    """The turns' repaired roles and their parts of the rendered text."""
    out = []
    for i, (role, text, (before, after, merged)) in enumerate(zip(roles, texts, path)):
        text = (text or "").replace(OPEN, "<|im_start |>").replace(CLOSE, "<|im_end |>")
        added = [] if merged else [ROLES[s - 1] for s in PATHS[before, after]]
        name = ROLES[after - 1]
        if merged:
            part = "\n" + text
        else:
            part = (CLOSE + "\n" if before != START else "") + "".join(_message(r) + CLOSE + "\n" for r in added) + _message(name, text)
        closing = []
        if last and i == len(roles) - 1:
            closing = ["user", "assistant"][after - 1 :] if after != ASSISTANT else []
            part += CLOSE + "\n" + "".join(_message(r) + CLOSE + "\n" for r in closing)
        change = "" if name == role else "relabel"
        action = "+".join(filter(None, [change, "merge" if merged else ""])) or "keep"
        out.append({"new_role": name, "action": action, "inserted_before": added, "inserted_after": closing, "part": part})
    return out


_SORTED = "conv_id bigint, turn bigint, role string, text string, pos bigint, summary string"


def format_turns(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row a turn, in order of (part, pos): the repaired role, what was done, and the turn's part of the rendered text.

    The parts of a conversation's turns, one after the other, are its rendered text.
    """
    spark = turns.sparkSession
    named = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number a part's rows, and sum up its first and last conversations."""
        pos, first, own, rows, several = 0, None, None, None, False
        for batch in batches:
            n = batch.num_rows
            for conv, turn_rows in groupby(zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()), lambda x: x[0]):
                if rows is None or conv != own:
                    if rows is not None:
                        several = True
                        first = first or {"conv": own, "rows": rows}
                    own, rows = conv, matrix([])
                for _, role in turn_rows:
                    rows = [forward(row, role) for row in rows]
            yield batch.append_column("pos", pa.array(range(pos, pos + n), pa.int64())).append_column("summary", pa.nulls(n, pa.string()))
            pos += n
        if rows is not None:
            ends = {"first": first or {"conv": own, "rows": rows}, "last": {"conv": own, "rows": rows}, "several": several}
            nulls = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())]
            yield pa.record_batch([*nulls, pa.array([json.dumps(ends)])], ["conv_id", "turn", "role", "text", "pos", "summary"])

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = named.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, _SORTED)
    numbered = stored(numbered.withColumn("part", F.spark_partition_id()), "turns")
    found = numbered.where("summary is not null").select("part", "summary").orderBy("part").collect()  # one row a part
    borders = _borders([(r[0], json.loads(r[1])) for r in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for part, own in groupby(rows, lambda r: r["part"]):
            pieces = groupby(own, lambda r: r["conv_id"])
            ready = next(pieces, None)
            ready = ready and (ready[0], list(ready[1]))
            begin = True
            while ready:
                conv, held = ready
                ready = next(pieces, None)
                ready = ready and (ready[0], list(ready[1]))
                entry, exit_state = START, None
                if begin:
                    entry, exit_state = borders[part][0]
                if not ready:
                    at_end = borders[part][1]
                    entry, exit_state = (at_end if not begin else (entry, at_end[1]))
                begin = False
                roles = [r["role"] for r in held]
                costs = [0 if s == entry else INF for s in range(4)]
                done = rendered(roles, [r["text"] for r in held], repair(roles, costs, exit_state), exit_state is None)
                out = [{k: r[k] for k in ("conv_id", "turn", "role", "part", "pos")} | {"rendered" if k == "part" else k: v for k, v in d.items()} for r, d in zip(held, done)]
                yield pa.RecordBatch.from_pylist(out, _OUT)

    again = numbered.where("summary is null").repartition(parts, "part").sortWithinPartitions("part", "pos")
    return again.select("conv_id", "turn", "role", "text", "part", "pos").mapInArrow(run, _OUT_DDL)


_OUT = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("part", pa.int32()), ("pos", pa.int64()),
        ("new_role", pa.string()), ("action", pa.string()), ("inserted_before", pa.list_(pa.string())),
        ("inserted_after", pa.list_(pa.string())), ("rendered", pa.string()),
    ]
)
_OUT_DDL = (
    "conv_id bigint, turn bigint, role string, part int, pos bigint, new_role string, action string, "
    "inserted_before array<string>, inserted_after array<string>, rendered string"
)


def _borders(parts: list[tuple[int, dict]]) -> dict[int, list[tuple[int, int | None]]]:
    """For each part, (entry state, exit state or None) of its first and of its last conversation's turns there."""
    out: dict[int, list] = {part: [(START, None), (START, None)] for part, _ in parts}
    i = 0
    while i < len(parts):
        j = i  # parts i to j share the last conversation of part i
        while j + 1 < len(parts) and parts[j + 1][1]["first"]["conv"] == parts[i][1]["last"]["conv"]:
            j += 1
            if parts[j][1]["several"]:
                break
        if j > i:
            chain = [parts[i][1]["last"]["rows"], *(parts[k][1]["first"]["rows"] for k in range(i + 1, j + 1))]
            costs = [[0, INF, INF, INF]]
            for rows in chain:
                costs.append([min(costs[-1][a] + rows[a][b] for a in range(4)) for b in range(4)])
            state = min(range(4), key=lambda s: costs[-1][s] + ENDING[s])
            for k in range(j, i - 1, -1):
                rows = chain[k - i]
                before = next(a for a in range(4) if costs[k - i][a] + rows[a][state] == costs[k - i + 1][state])
                piece = (before, None if k == j else state)
                if k > i:
                    out[parts[k][0]][0] = piece
                if k == i or not parts[k][1]["several"]:
                    out[parts[k][0]][1] = piece
                if k == i and not parts[k][1]["several"]:
                    out[parts[k][0]][0] = piece
                state = before
        i = max(j, i + 1)
    return out
