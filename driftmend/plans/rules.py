"""Repair rules as data: which table, which keys, which columns may change, and predicates as columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.functions.columns import differs


@dataclass(frozen=True)
class Relationship:
    """A foreign key of the main table and the dimension that gives it a key stable across snapshots.

    Rows whose natural keys differ between the sides conflict and are never repaired, and a natural key that a dimension
    repeats blocks an analysis; with audit, conflicts are only counted, over all rows of an identity.
    """

    name: str
    foreign_key: str
    dimension: str
    primary_key: str
    natural_key: str
    audit: bool = False


class Matched:
    """Names the columns of a matched pair for the predicates of a rule."""

    def __init__(self, rule: RuleSpec):
        self._rule = rule

    def old(self, column: str) -> Column:
        return F.col(f"old_{column}")

    def cur(self, column: str) -> Column:
        return F.col(f"cur_{column}")

    def differs(self, column: str) -> Column:
        """Null-safe: is the column another on the two sides?"""
        return differs(self.cur(column), self.old(column))

    def conflict(self, name: str) -> Column:
        """Is the natural key of a relationship, or a column of equal_on, another on the two sides?"""
        return F.col(f"{name}_conflict")

    def conflicts(self) -> Column:
        return functools.reduce(operator.or_, [self.conflict(n) for n in self._rule.conflict_names], F.lit(False))


Predicate = Callable[[Matched], Column]


@dataclass(frozen=True)
class Flag:
    """A further count of matched rows, and why a plan warns of it."""

    name: str
    predicate: Predicate
    warning: str


@dataclass(frozen=True)
class RuleSpec:
    """What a rule reads, writes and protects, and what it makes of a matched pair of rows.

    relationships: any number, of which those that aren't audits must agree, as must the columns of equal_on, each with the name
    its conflicts are counted under. candidate says which rows are repaired and preserved which are meant to be as they are,
    both as columns over a Matched; whatever they say, a row in conflict is no candidate. A row without conflict that is
    neither, and differs in kind or a compared column, is an unknown difference. kind: the column whose old value candidates
    are counted by. tallies: (name, compared column) to count candidates by. statement: the predicate in words, for plans.
    """

    id: str
    version: str
    priority: int
    table: str
    identity: str
    row_key: str
    statement: str
    kind: str
    relationships: tuple[Relationship, ...]
    equal_on: tuple[tuple[str, str], ...]
    authorized: tuple[str, ...]
    protected: tuple[str, ...]
    compared: tuple[str, ...]
    candidate: Predicate
    preserved: Predicate
    required: tuple[tuple[str, tuple[str, ...]], ...]
    tallies: tuple[tuple[str, str], ...] = ()
    flags: tuple[Flag, ...] = ()

    @property
    def parents(self) -> tuple[Relationship, ...]:
        """The relationships that must agree."""
        return tuple(r for r in self.relationships if not r.audit)

    @property
    def audits(self) -> tuple[Relationship, ...]:
        return tuple(r for r in self.relationships if r.audit)

    @property
    def conflict_names(self) -> tuple[str, ...]:
        return (*(r.name for r in self.parents), *(name for _, name in self.equal_on))

    @property
    def carried(self) -> tuple[str, ...]:
        """The columns of either side that a comparison needs, natural keys among them."""
        return tuple(dict.fromkeys([*(f"{r.name}_key" for r in self.parents), *(c for c, _ in self.equal_on), self.kind, *self.compared, *self.authorized]))

    def conflict_columns(self) -> dict[str, Column]:
        p = Matched(self)
        return {f"{r.name}_conflict": p.differs(f"{r.name}_key") for r in self.parents} | {f"{name}_conflict": p.differs(c) for c, name in self.equal_on}

    def is_candidate(self) -> Column:
        p = Matched(self)
        return self.candidate(p) & ~p.conflicts()

    def is_preserved(self) -> Column:
        return self.preserved(Matched(self))

    def is_unknown(self) -> Column:
        """Three-valued on purpose: null where the predicates are, as with a missing kind."""
        p = Matched(self)
        changed = functools.reduce(operator.or_, [p.differs(c) for c in self.compared], p.differs(self.kind))
        return ~p.conflicts() & ~self.is_candidate() & ~self.is_preserved() & changed


PLACEHOLDER = 106  # fixed value: the kind of a row whose content is gone

MESSAGE_RULE = RuleSpec(
    id="message-placeholder",
    version="3",
    priority=1,
    table="message",
    identity="msg_id",
    row_key="msg_pk",
    statement="content_type is 106 now and was another, chat_mid and ts are as they were",
    kind="content_type",
    relationships=(Relationship("chat", "chat_pk", "chat", "chat_pk", "chat_mid"), Relationship("sender", "sender_pk", "user", "user_pk", "user_mid", audit=True)),
    equal_on=(("ts", "timestamp"),),
    authorized=("content_type", "txt", "meta"),
    protected=("msg_id", "chat_pk", "sender_pk", "ts", "thumb"),
    compared=("txt", "meta", "thumb"),
    candidate=lambda p: (p.cur("content_type") == PLACEHOLDER) & p.old("content_type").isNotNull() & (p.old("content_type") != PLACEHOLDER),
    preserved=lambda p: (p.cur("content_type") == PLACEHOLDER) & (p.old("content_type") == PLACEHOLDER),
    required=(("message", ("msg_pk", "msg_id", "chat_pk", "sender_pk", "ts", "content_type", "txt", "meta", "thumb")), ("chat", ("chat_pk", "chat_mid")), ("user", ("user_pk", "user_mid"))),
    tallies=(("text_differences", "txt"), ("metadata_differences", "meta")),
    flags=(Flag("null_old_type", lambda p: (p.cur("content_type") == PLACEHOLDER) & p.old("content_type").isNull(), "placeholders whose old kind is missing are left as they are"),),
)

#: orders that have lost their price: two parents, two columns that must agree, and no audit
ORDER_RULE = RuleSpec(
    id="order-price",
    version="1",
    priority=2,
    table="purchase",
    identity="order_no",
    row_key="order_pk",
    statement="cents and note are missing now, cents was there; buyer, country, day and state are as they were",
    kind="urgency",
    relationships=(Relationship("buyer", "buyer_pk", "buyer", "buyer_pk", "buyer_name"), Relationship("country", "country_pk", "country", "country_pk", "country_name")),
    equal_on=(("day", "day"), ("state", "state")),
    authorized=("cents", "note"),
    protected=("order_no", "buyer_pk", "country_pk", "day", "state", "urgency"),
    compared=("cents", "note"),
    candidate=lambda p: p.cur("cents").isNull() & p.cur("note").isNull() & p.old("cents").isNotNull(),
    preserved=lambda p: p.cur("cents").isNull() & p.old("cents").isNull(),
    required=(("purchase", ("order_pk", "order_no", "buyer_pk", "country_pk", "day", "state", "urgency", "cents", "note")), ("buyer", ("buyer_pk", "buyer_name")), ("country", ("country_pk", "country_name"))),
    tallies=(("note_differences", "note"),),
    flags=(Flag("negative_prices", lambda p: p.old("cents") < 0, "prices below zero are restored as they were"),),
)

RULES = (MESSAGE_RULE, ORDER_RULE)


def schema_fingerprint(columns: DataFrame) -> DataFrame:
    """(snapshot_id, tables, columns, digest) of columns (snapshot_id, table_name, pos, column_name).

    The digest covers tables and columns in order, each with its length.
    """
    part = F.concat_ws(":", F.length("table_name"), "table_name", "pos", F.length("column_name"), "column_name")
    # a snapshot's schema is one bounded list
    return columns.groupBy("snapshot_id").agg(
        F.countDistinct("table_name").alias("tables"), F.count("*").alias("columns"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ","), 256).alias("digest"),
    )


def schema_gaps(columns: DataFrame, snapshots: DataFrame, required: list[tuple[str, str, str]]) -> DataFrame:
    """(snapshot_id, rule, gap) for each required (rule, table_name, column_name) that a snapshot lacks: table.column, or table (table)."""
    tables = columns.select("snapshot_id", "table_name").distinct().withColumn("_table", F.lit(True))
    need = snapshots.select("snapshot_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for r, t, c in required])).alias("r")).select("snapshot_id", "r.*")
    lacking = need.join(columns.select("snapshot_id", "table_name", "column_name"), ["snapshot_id", "table_name", "column_name"], "left_anti")
    gap = F.when(F.col("_table"), F.concat_ws(".", "table_name", "column_name")).otherwise(F.concat(F.col("table_name"), F.lit(" (table)")))
    return lacking.join(tables, ["snapshot_id", "table_name"], "left").select("snapshot_id", "rule", gap.alias("gap")).distinct()


def rule_selection(pairs: DataFrame, gaps: DataFrame, rules: list[tuple[str, int]]) -> DataFrame:
    """(pair_id, rule, gaps, missing): the rule of least priority whose needs both snapshots of a pair meet.

    Where none is met, rule is null, gaps the number of what is lacking, and missing lists it for each rule as (rule, gaps), with
    old: or current: before each. pairs: (pair_id, old_id, current_id); rules: (rule, priority) each.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_id").alias("snapshot_id")) for side in ("old", "current")]))
    # a snapshot lacks at most what the rules require, so these lists are short
    each = pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.*").join(gaps, "snapshot_id")
    each = each.groupBy("pair_id", "rule").agg(F.array_sort(F.collect_list(F.concat_ws(":", "side", "gap"))).alias("lacks"))
    every = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("priority")) for r, p in rules])).alias("r")).select("pair_id", "r.rule", "r.priority")
    scored = every.join(each, ["pair_id", "rule"], "left").withColumn("n", F.coalesce(F.size("lacks"), F.lit(0)))
    told = scored.groupBy("pair_id").agg(
        F.min_by("rule", F.when(F.col("n") == 0, F.col("priority"))).alias("rule"), F.sum("n").alias("gaps"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("rule", F.col("lacks").alias("gaps"))))).alias("missing"),
    )
    met = F.col("rule").isNotNull()
    return told.select("pair_id", "rule", F.when(met, F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps"), F.when(met, F.slice("missing", 1, 0)).otherwise(F.col("missing")).alias("missing"))
