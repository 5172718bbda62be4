"""Classification of every identity of a snapshot pair.

One DataFrame serves all counts: each side is reduced to one row per identity with its number of rows (partial
aggregation, so a much repeated or missing identity is no hot key), and the two are joined once. An identity that
any side has twice is a duplicate and takes no further part; null identities stay in one row for their counts.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.plans.rules import Matched, RuleSpec
from driftmend.sources.snapshots import SnapshotPair


def resolved(pair: SnapshotPair, side: str, rule: RuleSpec) -> DataFrame:
    """The main table of a side with the natural key of each parent as name_key (null where there is none)."""
    tables = getattr(pair, side)
    rows = tables[rule.table]
    for rel in rule.parents:
        dim = tables[rel.dimension].select(F.col(rel.primary_key).alias(rel.foreign_key), F.col(rel.natural_key).alias(f"{rel.name}_key"))
        rows = rows.join(dim, rel.foreign_key, "left")
    return rows


def _reduced(pair: SnapshotPair, side: str, rule: RuleSpec, compare: str) -> DataFrame:
    prefix = "old" if side == "old" else "cur"
    wide = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256) if compare == "digest" and c in rule.compared else F.col(c)
    return resolved(pair, side, rule).groupBy(rule.identity).agg(F.count("*").alias(f"n_{prefix}"), *[F.first(wide(c)).alias(f"{prefix}_{c}") for c in rule.carried])


def classify(pair: SnapshotPair, rule: RuleSpec, compare: str = "value", how: str = "full_outer") -> DataFrame:
    """One row per identity: n_old, n_cur, class, what conflicts and differs, and the rule's predicates.

    class is duplicated, matched, old_only, current_only or unidentified (null identity, one row a side). Flags
    are null unless matched. compare="digest" joins on digests of the compared columns, not their values, for rules whose predicates
    ask of them only whether they differ or are missing. how="inner" leaves out what one side lacks, and keeps the rows where they are
    if both sides are dealt out by identity.
    """
    old, cur = _reduced(pair, "old", rule, compare), _reduced(pair, "current", rule, compare)
    both = old.join(cur, rule.identity, how)
    kind = (
        F.when(F.col(rule.identity).isNull(), "unidentified").when((F.col("n_old") > 1) | (F.col("n_cur") > 1), "duplicated")
        .when(F.col("n_cur").isNull(), "old_only").when(F.col("n_old").isNull(), "current_only").otherwise("matched")
    )
    both = both.withColumn("class", kind)
    only = lambda c: F.when(F.col("class") == "matched", c)
    both = both.withColumns({k: only(c) for k, c in rule.conflict_columns().items()} | {f"{c}_differs": only(Matched(rule).differs(c)) for c in rule.compared})
    both = both.withColumns({"candidate": only(rule.is_candidate()), "preserved": only(rule.is_preserved()), "unknown": only(rule.is_unknown())})
    return both.withColumn("open", (F.col("class") == "matched") & ~Matched(rule).conflicts() & F.col("unknown").isNull())


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def analysis_counts(classified: DataFrame, rule: RuleSpec, blocking: DataFrame | None = None) -> DataFrame:
    """One row with every count of an analysis (audits and counts by kind are queries of their own).

    Conflicts of each parent are counted, and those of a column of equal_on where no parent is in conflict. blocking: rows of
    duplicate_naturals. If there are any, an analysis stops before it compares: only rows, missing and repeated
    identities are counted, all else is 0.
    """
    of = lambda c: F.col("class") == c
    total = lambda n, c=None: F.coalesce(F.sum(F.when(of(c), F.col(n)) if c else F.col(n)), F.lit(0)).cast("long")
    p = Matched(rule)
    apart = functools.reduce(operator.or_, [p.conflict(r.name) for r in rule.parents], F.lit(False))
    conflicts = [_n(p.conflict(r.name)).alias(f"{r.name}_conflicts") for r in rule.parents] + [_n(p.conflict(name) & ~apart).alias(f"{name}_conflicts") for _, name in rule.equal_on]
    counts = classified.agg(
        total("n_old").alias("old_messages"), total("n_cur").alias("current_messages"),
        total("n_old", "unidentified").alias("null_ids_old"), total("n_cur", "unidentified").alias("null_ids_current"),
        _n(of("duplicated")).alias("duplicate_ids"), _n(of("matched")).alias("matched"), _n(of("old_only")).alias("old_only"), _n(of("current_only")).alias("current_only"),
        *conflicts, _n(F.col("candidate")).alias("candidates"), *[_n(F.col("candidate") & F.col(f"{c}_differs")).alias(name) for name, c in rule.tallies],
        _n(F.col("preserved")).alias("preserved_placeholders"), _n(F.col("unknown")).alias("unknown_differences"),
        *[_n(of("matched") & f.predicate(p)).alias(f.name) for f in rule.flags], _n(F.col("open")).alias("residual_unclassified"),
    )
    if blocking is None:
        return counts
    stop = blocking.agg((F.count("*") > 0).alias("_blocked"))
    each = [F.col(c) if c in BEFORE_BLOCKERS else F.when(F.col("_blocked"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in counts.columns]
    return counts.join(stop).select(*each)  # two tables of one row each


#: counted before blockers stop an analysis
BEFORE_BLOCKERS = ("old_messages", "current_messages", "null_ids_old", "null_ids_current", "duplicate_ids")


def flagged(classified: DataFrame, rule: RuleSpec, name: str) -> DataFrame:
    """The matched rows with one of the rule's flags."""
    (flag,) = [f for f in rule.flags if f.name == name]
    return classified.filter((F.col("class") == "matched") & flag.predicate(Matched(rule)))


def candidates(classified: DataFrame, rule: RuleSpec) -> DataFrame:
    """(identity, old_type, and for each tally whether its column differs) of the rows to repair."""
    differ = [F.col(f"{c}_differs").alias(name.removesuffix("_differences") + "_differs") for name, c in rule.tallies]
    return classified.filter("candidate").select(rule.identity, F.col(f"old_{rule.kind}").alias("old_type"), *differ)


def candidates_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("old_type").agg(F.count("*").alias("n"))


def duplicate_identities(pair: SnapshotPair, rule: RuleSpec) -> DataFrame:
    """(identity): values that occur more than once on either side."""
    one = lambda t: t.filter(F.col(rule.identity).isNotNull()).groupBy(rule.identity).agg(F.count("*").alias("n")).filter("n > 1").select(rule.identity)
    return one(pair.old[rule.table]).union(one(pair.current[rule.table])).distinct()


def duplicate_naturals(pair: SnapshotPair, rule: RuleSpec) -> DataFrame:
    """(side, relationship, key, n): natural keys that a parent's dimension holds more than once: these block an analysis (analysis_counts, plan_record)."""
    found = []
    for side in ("old", "current"):
        for rel in rule.parents:
            keys = getattr(pair, side)[rel.dimension].select(F.lit(side).alias("side"), F.lit(rel.name).alias("relationship"), F.col(rel.natural_key).cast("string").alias("key"))
            found.append(keys.filter("key is not null").groupBy("side", "relationship", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    if not found:
        return pair.old[rule.table].sparkSession.createDataFrame([], "side string, relationship string, key string, n long")
    return functools.reduce(DataFrame.union, found)


def null_identity_counts(pair: SnapshotPair, rule: RuleSpec) -> DataFrame:
    one = lambda side: getattr(pair, side)[rule.table].agg(F.count_if(F.col(rule.identity).isNull()).alias("null_ids"), F.count("*").alias("n_rows")).select(F.lit(side).alias("side"), "null_ids", "n_rows")
    return one("old").union(one("current"))


PARTS = 200  # that the rows of an audit are dealt into, at least


def audit_conflicts(pair: SnapshotPair, rule: RuleSpec) -> DataFrame:
    """One row with name_conflicts for each audit: pairs of rows with one identity, duplicates crossed, whose natural keys differ.

    Counted from rows per identity and key, so that copies of an identity are never crossed. Rows are dealt into a fixed number of
    parts, first by identity, key and a digit of their own, so that the rows of one identity are combined in several tasks, then by identity:
    no task holds more than its part of the identities, however well their shuffled rows compress.
    """
    spark, found = pair.old[rule.table].sparkSession, None
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for rel in rule.audits:

        def side(name: str, after: int, rel=rel) -> DataFrame:
            tables = getattr(pair, name)
            dim = tables[rel.dimension].select(F.col(rel.primary_key).alias(rel.foreign_key), F.col(rel.natural_key).alias("who"))
            rows = tables[rule.table].filter(F.col(rule.identity).isNotNull()).join(dim, rel.foreign_key, "left")
            return rows.select(rule.identity, "who", F.pmod(F.xxhash64(rule.row_key), F.lit(16)).alias("digit"), F.lit(1 - after).alias("o"), F.lit(after).alias("c"))

        counts = [F.sum("o").alias("o"), F.sum("c").alias("c")]
        dealt = side("old", 0).unionByName(side("current", 1)).repartition(parts, rule.identity, "who", "digit").groupBy(rule.identity, "who", "digit").agg(*counts)
        each = dealt.select(rule.identity, "who", "o", "c").repartition(parts, rule.identity).groupBy(rule.identity, "who").agg(*counts)
        per = each.groupBy(rule.identity).agg((F.sum("o") * F.sum("c") - F.sum(F.col("o") * F.col("c"))).alias("n"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"{rel.name}_conflicts"))
        found = one if found is None else found.join(one)  # tables of one row each
    return spark.range(1).select() if found is None else found


def unpivoted(row: DataFrame, value: str = "n", name: str = "metric") -> DataFrame:
    """A one-row table of counts as (metric, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("long").alias(value)) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def exclusion_reasons(rule: RuleSpec) -> tuple[str, ...]:
    conflicts = (*rule.conflict_names, *(r.name for r in rule.audits))
    return ("old_only", "current_only", "preserved_placeholders", *(f"{n}_conflicts" for n in conflicts), "unknown_differences", "null_ids_old", "null_ids_current", "duplicate_ids")


def exclusions(counts: DataFrame, audits: DataFrame, rule: RuleSpec) -> DataFrame:
    """(reason, n) of what a plan leaves alone, without zeros."""
    both = unpivoted(counts, name="reason")
    if audits.columns:
        both = both.union(unpivoted(audits, name="reason"))
    return both.filter(F.col("reason").isin(*exclusion_reasons(rule)) & (F.col("n") > 0))
