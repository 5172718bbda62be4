"""Streaming forms: stage events folded as they arrive, in any order, and arriving rows classified against a fixed old snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from driftmend.operators.ledger import EVENTS, LETTERS, STAGES, STATES
from driftmend.plans.rules import RuleSpec

_BLOCK = "seqs array<long>, stages array<int>, kinds array<string>, effects array<string>, late long, touched long"


def composed(effects: list[str], then: list[str]) -> list[str]:
    """What some events, and others after them, make of each stage."""
    return [a.translate(str.maketrans(LETTERS, b)) for a, b in zip(effects, then)]


def effects_of(events: list[tuple[int, int, str]], stages: tuple[int, ...] = STAGES) -> list[str]:
    """What events (seq, stage, kind), in order of seq, make of each stage."""
    now = [LETTERS] * len(stages)
    for _, stage, kind in sorted(events):
        if kind in EVENTS and kind != "invalidate":
            now = composed(now, [EVENTS[kind] if s == stage else EVENTS["invalidate"] if kind == "begin" and s > stage else LETTERS for s in stages])
    return now


class LedgerFold(StatefulProcessor):
    """A session's events by blocks of seq: those of a block while it is open, and what they make of each stage.

    An event puts only its own block in order again. A block that had no event for settle_ms is closed: its events go, what
    they come to stays, and what arrives later for it is counted as late and not applied.
    """

    def __init__(self, block: int, settle_ms: int | None):
        self.block, self.settle_ms = block, settle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", _BLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.settle_ms is not None else 0
        for batch in rows:
            for number, part in batch.groupby(batch["seq"] // self.block):
                self._add((int(number),), list(zip(part["seq"].tolist(), part["stage"].tolist(), part["kind"].tolist())), now)
        if self.settle_ms is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.settle_ms)
        yield self._states(key)

    def _add(self, number: tuple[int], events: list[tuple[int, int, str]], now: int) -> None:
        held = self.blocks.getValue(number) if self.blocks.containsKey(number) else ([], [], [], [], 0, 0)
        seqs, stages, kinds, effects, late, _ = held
        if seqs is None:
            self.blocks.updateValue(number, (None, None, None, list(effects), late + len(events), now))
            return
        known = dict(zip(seqs, zip(stages, kinds))) | {int(s): (int(k), str(e)) for s, k, e in events}  # an event told twice is one
        every = [(s, *x) for s, x in sorted(known.items())]
        self.blocks.updateValue(number, ([e[0] for e in every], [e[1] for e in every], [e[2] for e in every], effects_of(every), late, now))

    def _states(self, key) -> pd.DataFrame:
        blocks = sorted((k[0], list(v[3]), v[4]) for k, v in self.blocks.iterator())
        whole = [LETTERS] * len(STAGES)
        for _, effects, _ in blocks:
            whole = composed(whole, effects)
        return pd.DataFrame({"session_id": key[0], "stage": list(STAGES), "state": [STATES[e[0]] for e in whole], "late": sum(b[2] for b in blocks)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentProcessingTimeInMs(), []
        for number, (seqs, _, _, effects, late, touched) in list(self.blocks.iterator()):
            if seqs is not None and touched + self.settle_ms <= now:
                self.blocks.updateValue(number, (None, None, None, list(effects), late, touched))
            elif seqs is not None:
                left.append(touched + self.settle_ms)
        if left:
            self.handle.registerTimer(min(left))
        return iter([])

    def close(self) -> None:
        pass


def stage_state_stream(events: DataFrame, block: int = 4096, settle_ms: int | None = None) -> DataFrame:
    """(session_id, stage, state, late): states of all stages of each session that has new events, in whatever order they arrive.

    events (session_id, seq, stage, kind): one for each seq of a session; of two with one seq the later one counts. Rows without
    session, seq or stage are left out; unknown kinds change nothing. settle_ms: after so long without an event a block of
    `block` sequence numbers is closed, so that the state holds events of recent blocks alone, and `late` counts the
    events that came too late to be applied (of such a session the batch fold knows more); None keeps all blocks open. The
    state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    slim = events.select("session_id", "seq", F.col("stage").cast("int").alias("stage"), "kind").dropna(subset=["session_id", "seq", "stage"])
    mode = "None" if settle_ms is None else "ProcessingTime"
    return slim.groupBy("session_id").transformWithStateInPandas(LedgerFold(block, settle_ms), "session_id long, stage int, state string, late long", "Update", mode)


def candidate_stream(arriving: DataFrame, old: DataFrame, rule: RuleSpec) -> DataFrame:
    """Arriving current rows that are candidates against a static old side (both with the name_key of each parent).

    Identities that the old side has twice are left out; whether the current side repeats one is only known at
    the end, so what this finds is planned only after a full classification.
    """
    unique = old.groupBy(rule.identity).agg(F.count("*").alias("n"), *[F.first(c).alias(f"old_{c}") for c in rule.carried]).filter("n = 1")
    both = arriving.join(unique, rule.identity).withColumnsRenamed({c: f"cur_{c}" for c in rule.carried})
    return both.withColumns(rule.conflict_columns()).filter(rule.is_candidate()).select(rule.identity, f"old_{rule.kind}")
