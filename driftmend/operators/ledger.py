"""Stage states folded from event logs, for all sessions at once.

An event begins, commits, fails or cancels a stage of a session. A commit counts only while the stage runs; a begin
invalidates every later stage that is not pending.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.functions.columns import differs

STAGES = (0, 1, 2, 3, 4, 5)


#: states by letter (K: invalidated after a commit, whose outputs stay), and what each event makes of each of them
STATES = {"P": "pending", "R": "running", "C": "committed", "F": "failed", "X": "cancelled", "I": "invalidated", "K": "invalidated"}
LETTERS = "".join(STATES)
EVENTS = {"begin": "RRRRRRR", "commit": "PCCFXIK", "fail": "FFFFFFF", "cancel": "XXXXXXX", "invalidate": "PIKIIIK"}


def _folded(order: str) -> Column:
    """The effects of some events, or of some blocks of events, one after the other."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(order, "effect"))), F.lit(LETTERS), lambda now, e: F.call_function("translate", now, F.lit(LETTERS), e["effect"]))


def stage_states(events: DataFrame, stages: tuple[int, ...] = STAGES, block: int = 4096) -> DataFrame:
    """(session_id, stage, state, holds): running, committed, failed, cancelled or invalidated; pending stages have no row.

    holds: does the stage still have the outputs of a commit? Beginning, failing and cancelling it clear them, invalidating it doesn't.

    events: (session_id, seq, stage, kind), one for each seq of a session. A begin is copied to each later stage as an
    invalidation. An event maps each state of its stage to a state, written as seven letters, and such maps compose, so
    the events of a session are first composed in blocks of `block` sequence numbers and then block by block: a
    session of any length is spread over tasks. Events of unknown kind change nothing.
    """
    later = F.filter(F.lit(list(stages)).cast("array<int>"), lambda s: s > F.col("stage"))
    hits = events.filter("kind = 'begin'").select("session_id", "seq", F.explode(later).alias("stage"), F.lit("invalidate").alias("kind"))
    every = events.select("session_id", "seq", F.col("stage").cast("int").alias("stage"), "kind").unionByName(hits)
    effect = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])[F.col("kind")]
    told = every.withColumns({"effect": effect, "block": F.floor(F.col("seq") / block)}).filter("effect is not null")
    parts = told.groupBy("session_id", "stage", "block").agg(_folded("seq").alias("effect"))
    whole = parts.groupBy("session_id", "stage").agg(_folded("block").alias("effect"))
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.substring("effect", 1, 1)]
    return whole.select("session_id", "stage", state.alias("state"), F.substring("effect", 1, 1).isin("C", "K").alias("holds")).filter("state <> 'pending'")


def interrupted_stages(states: DataFrame) -> DataFrame:
    """Stages still running when a session is opened again: they have failed."""
    return states.filter("state = 'running'").select("session_id", "stage", F.lit("failed").alias("state"))


def cleanup_set(outputs: DataFrame, states: DataFrame) -> DataFrame:
    """Sensitive outputs that any stage still has, whether it is committed or was invalidated since. outputs: those of each stage's last commit."""
    return outputs.filter("sensitive").join(states.filter("holds").select("session_id", "stage"), ["session_id", "stage"], "left_semi").select("session_id", "stage", "path", "size")


@dataclass(frozen=True)
class Need:
    """A flag that a stage waits for, and what is said while it isn't there."""

    flag: str
    reason: str


COMMITTED = "committed:"  # before a stage's number: the flag that it is committed

#: what each stage needs before it may be begun by hand; a text instead says why it never may
GATES: dict[int, tuple[Need, ...] | str] = {
    0: (),
    1: (Need("old_intake", "old intake isn't complete"), Need("current_intake", "current intake isn't complete")),
    2: (Need(f"{COMMITTED}1", "no analysis"),),
    3: (
        Need(f"{COMMITTED}1", "no analysis"), Need("plan_actionable", "plan isn't actionable"), Need("current_patchable", "current side isn't patchable"), Need("destination_selected", "no destination"),
        Need("review_acknowledged", "review isn't acknowledged"), Need("count_typed", "count isn't typed"), Need("confirmed", "confirmation differs from plan"),
    ),
    4: "runs by itself after patching",
    5: (Need("verified", "not verified"),),
}
BUSY = "an operation is running"


def stage_gate(sessions: DataFrame, states: DataFrame, evidence: DataFrame, gates: dict[int, tuple[Need, ...] | str] = GATES) -> DataFrame:
    """(session_id, stage, can_run, blockers): may a stage be begun by hand, and if not, why, in the order of its needs.

    sessions (session_id): all of them, those without events or evidence too. evidence (session_id, stage, flag, value): what
    stages have found out; it counts only while its stage is committed, without a stage always. A flag without true
    evidence is false. While any stage of a session runs nothing may be begun.
    """
    done = states.filter("state = 'committed'").select("session_id", "stage")
    backed = evidence.filter("value and stage is null").select("session_id", "flag")
    backed = backed.union(evidence.filter("value").join(done, ["session_id", "stage"], "left_semi").select("session_id", "flag"))
    told = backed.union(done.select("session_id", F.concat(F.lit(COMMITTED), F.col("stage").cast("string")))).union(states.filter("state = 'running'").select("session_id", F.lit(BUSY)))
    # a session has no more flags than stages can find out
    flags = told.groupBy("session_id").agg(F.collect_set("flag").alias("flags"))
    each = sessions.select("session_id").distinct().join(flags, "session_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    has = lambda flag: F.array_contains("flags", flag)
    missing = lambda needs: [F.lit(needs)] if isinstance(needs, str) else [F.when(~has(n.flag), F.lit(n.reason)) for n in needs]
    blocked = [F.struct(F.lit(stage).alias("stage"), F.array_compact(F.array(F.when(has(BUSY), F.lit(BUSY)), *missing(needs))).alias("blockers")) for stage, needs in gates.items()]
    return each.select("session_id", F.explode(F.array(*blocked)).alias("g")).select("session_id", "g.stage", (F.size("g.blockers") == 0).alias("can_run"), F.array_join("g.blockers", ",").alias("blockers"))


def unregistered_outputs(found: DataFrame, outputs: DataFrame, states: DataFrame) -> DataFrame:
    """Files (path, size) that no committed stage has registered with that size."""
    known = outputs.join(states.filter("state = 'committed'").select("session_id", "stage"), ["session_id", "stage"], "left_semi").select("path", "size")
    return found.select("path", "size").join(known, ["path", "size"], "left_anti")


def committed_output_check(outputs: DataFrame, states: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, path, problem) of committed outputs that are missing or have another hash now."""
    kept = outputs.join(states.filter("state = 'committed'").select("session_id", "stage"), ["session_id", "stage"], "left_semi")
    now = found.select("path", F.col("hash").alias("now"), F.lit(True).alias("there"))
    problem = F.when(F.col("there").isNull(), "missing").when(differs(F.col("hash"), F.col("now")), "changed")
    return kept.join(now, "path", "left").select("session_id", "path", problem.alias("problem")).filter("problem is not null")
