"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning with
the user. Each given turn may be relabelled, merged into the turn before it, or preceded by empty turns, at a
cost; dynamic programming over the automaton of legal turns picks the cheapest whole repair, of equally
cheap ones the one with the fewest turns. The repaired turns are rendered under role headers.

Costs add up along a conversation, so a stretch of turns is a (min, +) matrix between automaton states.
Turns are sorted by range and cut into blocks of bounded size, whose numbers are written with them. The matrices of
the first and last conversation of each block are composed first, conversation by conversation, then every
block traces its turns by itself. So a conversation of any length is spread over tasks, and it makes no
difference how files are split when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import written

ROLES = ("system", "user", "assistant")
START, NONE = 3, 4  # states: the role of the last turn, or START; NONE: a role that isn't known
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
RELABEL, UNKNOWN_ROLE, MERGE, INSERT = 4, 1, 2, 3
STATES = 4
_TURNS = 1 << 31  # a cost unit weighs more than any number of turns
_FAR = 1 << 61
TURNS, BYTES = 1 << 14, 8_000_000  # turns and bytes of text in a block, about


@cache
def moves(given: int) -> dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]]:
    """For a turn of a given role: (state before, state after) to (weight, merged, roles inserted before)."""
    found: dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]] = {}
    for before in range(STATES):
        for role in range(3):
            label = 0 if role == given else UNKNOWN_ROLE if given == NONE else RELABEL
            options = [(label + MERGE, True, ())] if role == before else []
            if role in FOLLOWS[before]:
                options.append((label, False, ()))
            options += [(label + INSERT, False, (x,)) for x in FOLLOWS[before] if role in FOLLOWS[x]]
            if options:
                cost, merged, inserted = min(options, key=lambda o: (o[0], len(o[2]) + (not o[1])))
                found[before, role] = (cost * _TURNS + len(inserted) + (not merged), merged, inserted)
    return found


@cache
def matrix(given: int) -> np.ndarray:
    m = np.full((STATES, STATES), _FAR, np.int64)
    for (a, b), (weight, _, _) in moves(given).items():
        m[a, b] = weight
    return m


def stretch(given: list[int]) -> np.ndarray:
    """The matrix of a stretch of turns, composed in pairs, pairs of pairs, and so on."""
    alone = np.full((STATES, STATES), _FAR, np.int64)
    np.fill_diagonal(alone, 0)
    m = np.stack([alone, *(matrix(g) for g in range(NONE + 1) if g != START), alone])[[0, *([1, 2, 3, 0, 4][g] for g in given)]]
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, alone[None]])
        m = np.minimum((m[::2, :, :, None] + m[1::2, None, :, :]).min(2), _FAR)
    return m[0]


def trace(given: list[int], start: int = START, end: int | None = None) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(role, merged, roles inserted before) of each turn on the cheapest way from start to end (None: any)."""
    at = [_FAR] * STATES
    at[start] = 0
    back = []
    for g in given:
        after, via = [_FAR] * STATES, [-1] * STATES
        for (a, b), (weight, _, _) in moves(g).items():
            if at[a] + weight < after[b]:
                after[b], via[b] = at[a] + weight, a
        at = after
        back.append(via)
    state = min(range(STATES), key=lambda s: at[s]) if end is None else end
    out = []
    for g, via in zip(reversed(given), reversed(back)):
        before = via[state]
        _, merged, inserted = moves(g)[before, state]
        out.append((state, merged, inserted))
        state = before
    return out[::-1]


def _number(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else NONE


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition with its number p, the number b of their block, and their place i in the partition."""
    p, b, i, turns, size = TaskContext.get().partitionId(), 0, 0, 0, 0
    for batch in batches:
        numbers = []
        for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
            if turns and (turns >= most or size + n > BYTES):
                b, turns, size = b + 1, 0, 0
            turns, size = turns + 1, size + n
            numbers.append(b)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p] * n), pa.array(numbers, pa.int64()), pa.array(range(i, i + n), pa.int64())], names=[*batch.schema.names, "p", "b", "i"])
        i += n


def _segments(conversations: list) -> list[tuple[int, int]]:
    """(first, end) of the stretches of equal values."""
    cuts = [0, *(k for k in range(1, len(conversations)) if conversations[k] != conversations[k - 1]), len(conversations)]
    return list(zip(cuts, cuts[1:]))


def _borders(rows: pa.Table) -> pa.Table:
    """The matrices of the first and the last conversation of a block; of one conversation alone, once."""
    rows = rows.sort_by("i")
    ends = _segments(rows.column("conv_id").to_pylist())
    at = [0, len(ends) - 1] if len(ends) > 1 else [0]
    given = [_number(r) for r in rows.column("role").to_pylist()]
    one = lambda c: rows.column(c).take(pa.array([ends[k][0] for k in at]))
    m = [stretch(given[slice(*ends[k])]).ravel().tolist() for k in at]
    return pa.table([one("p"), one("b"), pa.array([k > 0 for k in at]), one("conv_id"), pa.array([b - a for a, b in (ends[k] for k in at)], pa.int64()), pa.array(m, pa.list_(pa.int64()))], names=["p", "b", "last", "conv_id", "n", "m"])


def _settled(parts: pd.DataFrame) -> pd.DataFrame:
    """For the parts of a conversation, one for each block it is in: entry and exit state, turns and rows before."""
    parts = parts.sort_values(["p", "b"], ignore_index=True)
    ms = [np.array(m, np.int64).reshape(STATES, STATES) for m in parts["m"]]
    ahead = [np.where(np.arange(STATES) == START, 0, _FAR)]
    for m in ms:
        ahead.append(np.minimum((ahead[-1][:, None] + m).min(0), _FAR))
    state, entry, leave = int(ahead[-1].argmin()), [0] * len(ms), [0] * len(ms)
    for k in range(len(ms) - 1, -1, -1):
        leave[k] = state
        state = entry[k] = int((ahead[k] + ms[k][:, state]).argmin())
    turns = [int(ahead[k][e] % _TURNS) for k, e in enumerate(entry)]
    return parts[["p", "b", "last"]].assign(entry=entry, leave=leave, turns=turns, before=parts["n"].cumsum() - parts["n"])


def repair(turns: DataFrame, block: int = TURNS) -> DataFrame:
    """One row per row of turns (conv_id, turn, role, text), in the order of its conversation.

    conv_id, turn, role; position: the row's place in its conversation, from 0; new_role; merged: the row
    continues the turn before it; inserted: roles of the empty turns put before it, comma-joined; out_turn: number of
    the repaired turn it is in, from 0; cost of its changes; rendered: its part of the conversation.

    Turns are ordered by turn (null first), role, then hash of the text; rows that repeat each other are
    turns of their own. conv_id and turn may be of any type that can be sorted and compared, and keep it. A null or unknown role is relabelled; roles are compared without case or outer white
    space. A null text is an empty turn; rows with a null conv_id are one conversation. An empty table gives no
    rows; other columns are ignored. The parts of a conversation in order of position are its rendering.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    slim = turns.select("conv_id", "turn", text("role"), text("text"))
    order = ["conv_id", "turn", "role", "h"]
    ranged = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(*order, F.rand(1)).sortWithinPartitions(*order).drop("h")
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}
    table = written(ranged.mapInArrow(lambda batches: _blocks(batches, block), ", ".join(f"`{k}` {v}" for k, v in kind.items()) + ", p long, b long, i long"), "chat-turns")
    borders = table.select("conv_id", "role", "p", "b", "i").groupBy("p", "b").applyInArrow(_borders, f"p long, b long, last boolean, conv_id {kind['conv_id']}, n long, m array<long>")
    # a conversation has a part for each of the blocks that it fills, so these groups are small
    settled = borders.groupBy("conv_id").applyInPandas(_settled, "p long, b long, last boolean, entry int, leave int, turns long, before long")
    known = lambda last: F.max(F.when(F.col("last") == last, F.struct("entry", "leave", "turns", "before")))
    settled = written(settled.groupBy("p", "b").agg(known(False).alias("first_in"), known(True).alias("last_in")), "chat-borders")

    def fix(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        first_in, last_in = (rows.column(c)[0].as_py() for c in ("first_in", "last_in"))
        given = [_number(r) for r in rows.column("role").to_pylist()]
        texts = rows.column("text").to_pylist()
        ends, out = _segments(rows.column("conv_id").to_pylist()), []
        for k, (a, b) in enumerate(ends):
            inner = {"entry": START, "leave": None, "turns": 0, "before": 0}
            known = first_in if k == 0 else last_in if k == len(ends) - 1 else inner
            if known is None:
                raise ValueError("a block without its borders")
            turn, place = known["turns"], known["before"]
            for r, (role, merged, inserted) in zip(range(a, b), trace(given[a:b], known["entry"], known["leave"])):
                turn += len(inserted) + (not merged)
                cost = INSERT * len(inserted) + MERGE * merged + (0 if given[r] == role else UNKNOWN_ROLE if given[r] == NONE else RELABEL)
                text = "".join(f"<|{ROLES[x]}|>\n\n" for x in inserted) + ("" if merged else f"<|{ROLES[role]}|>\n") + (texts[r] or "") + "\n"
                out.append((place, ROLES[role], merged, ",".join(ROLES[x] for x in inserted), turn - 1, cost, text))
                place += 1
        kinds = {"position": pa.int64(), "new_role": pa.string(), "merged": pa.bool_(), "inserted": pa.string(), "out_turn": pa.int64(), "cost": pa.int64(), "rendered": pa.string()}
        return pa.table([*(rows.column(c) for c in ("conv_id", "turn", "role")), *(pa.array(c, kind) for c, kind in zip(zip(*out), kinds.values()))], names=["conv_id", "turn", "role", *kinds])

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, position long, new_role string, merged boolean, inserted string, out_turn long, cost long, rendered string"
    return table.join(settled, ["p", "b"]).groupBy("p", "b").applyInArrow(fix, schema)
