"""Repair plans: what is published (no identifiers, no texts) and how it is checked against what is found later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.functions.columns import differs, public_id, shown, tagged
from driftmend.operators.classify import analysis_counts, audit_conflicts, candidates, candidates_by_type, classify, duplicate_naturals, exclusions
from driftmend.operators.digest import table_digest
from driftmend.plans.rules import RuleSpec
from driftmend.sources.snapshots import SnapshotPair


def public_candidate_ids(found: DataFrame, rule: RuleSpec, salt: str) -> DataFrame:
    return found.select(public_id(F.lit(salt), F.col(rule.identity)).alias("public_id"))


def input_digests(pair: SnapshotPair) -> DataFrame:
    """(side, table_name, digest) of every table of both sides."""
    found = None
    for side in ("old", "current"):
        tables = getattr(pair, side)
        for name in sorted(tables):
            one = table_digest(tables[name], sorted(tables[name].columns)).select(F.lit(side).alias("side"), F.lit(name).alias("table_name"), "digest")
            found = one if found is None else found.union(one)
    return found


def snapshot_gaps(pair: SnapshotPair, rule: RuleSpec) -> list[str]:
    """What the rule requires and a side lacks: side:table (table) or side:table.column. Only schemas are read."""
    found = []
    for side in ("old", "current"):
        tables = getattr(pair, side)
        for table, columns in rule.required:
            if table not in tables:
                found.append(f"{side}:{table} (table)")
            else:
                found += [f"{side}:{table}.{c}" for c in columns if c not in tables[table].columns]
    return found


def _schemas(pair: SnapshotPair) -> Column:
    """(side, digest) of the columns of each side's tables."""
    text = lambda tables: "\n".join(f"{t}:" + ",".join(f"{f.name} {f.dataType.simpleString()}" for f in tables[t].schema) for t in sorted(tables))
    return F.array(*[F.struct(F.lit(side).alias("side"), F.sha2(F.lit(text(getattr(pair, side))), 256).alias("digest")) for side in ("old", "current")])


def _list(table: DataFrame, alias: str) -> DataFrame:
    """A table as one sorted array in one row. Only short tables: reasons, kinds, sides."""
    return table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(alias))


def select_rule(pair: SnapshotPair, rules: tuple[RuleSpec, ...]) -> tuple[RuleSpec | None, dict[str, list[str]]]:
    """(the rule of least priority whose needs both sides meet, or None; what each other rule lacks). Only schemas are read."""
    gaps = {r.id: snapshot_gaps(pair, r) for r in rules}
    met = [r for r in sorted(rules, key=lambda r: r.priority) if not gaps[r.id]]
    return met[0] if met else None, {k: v for k, v in gaps.items() if v}


def analyse(pair: SnapshotPair, rules: tuple[RuleSpec, ...], salt: str, created: Column) -> tuple[RuleSpec | None, DataFrame]:
    """(the selected rule, its plan); without one, None and an unsupported plan that lists as rule: gap what each rule lacks."""
    rule, lacking = select_rule(pair, rules)
    if rule is not None:
        return rule, plan_record(pair, rule, salt, created)
    every = [f"{r.id}: {gap}" for r in sorted(rules, key=lambda r: r.priority) for gap in lacking[r.id]]
    return None, plan_record(pair, min(rules, key=lambda r: r.priority), salt, created, every)


#: counts that a plan warns of, and why
WARNINGS = (
    ("null_ids_old", "old rows without an identity are never matched or written"),
    ("null_ids_current", "current rows without an identity are never matched or written"),
    ("duplicate_ids", "identities that a side repeats are left out of matching and repair"),
    ("residual_unclassified", "differing rows with a missing kind belong to no class"),
)


def plan_record(pair: SnapshotPair, rule: RuleSpec, salt: str, created: Column, gaps: list[str] | None = None) -> DataFrame:
    """One row with all that a repair is judged by later; it holds no identifier and no text of the data.

    status is unsupported (gaps: what the rule requires and a side lacks; no counts), diagnostic_only (blockers, or nothing
    to repair) or actionable. plan_id hashes all content but the salt and the time, so equal inputs give
    equal ids. gaps: where no rule is met, those of all rules.
    """
    spark = pair.current[rule.table].sparkSession if rule.table in pair.current else next(iter([*pair.current.values(), *pair.old.values()])).sparkSession
    gaps = snapshot_gaps(pair, rule) if gaps is None else gaps
    fixed = {
        "rule": F.lit(rule.id), "rule_version": F.lit(rule.version), "predicate": F.lit(rule.statement), "authorized": F.array(*map(F.lit, rule.authorized)), "protected": F.array(*map(F.lit, rule.protected)),
        "schemas": _schemas(pair), "gaps": F.array(*map(F.lit, gaps)).cast("array<string>"),
    }
    if gaps:
        row = spark.range(1).select(F.lit("unsupported").alias("status"), F.lit(0).cast("long").alias("predicted"), F.array().cast("array<string>").alias("blockers"))
    else:
        classified, blocking = classify(pair, rule), duplicate_naturals(pair, rule)
        counts = analysis_counts(classified, rule, blocking)
        audits = audit_conflicts(pair, rule)
        by_type = _list(candidates_by_type(candidates(classified, rule)), "by_type")
        key = F.create_map(*[F.lit(x) for r in rule.parents for x in (r.name, r.natural_key)])[F.col("relationship")] if rule.parents else F.col("relationship")
        blockers = _list(blocking.groupBy("side", "relationship").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "side", "n", F.lit("repeated"), key).alias("blocker")), "b")
        row = counts.join(_list(exclusions(counts, audits, rule), "exclusions")).join(by_type).join(_list(input_digests(pair), "inputs")).join(blockers)  # tables of one row each
        row = row.withColumn("blockers", F.transform("b", lambda b: b["blocker"])).drop("b")
        row = row.withColumn("by_type", F.when(F.size("blockers") == 0, F.col("by_type")).otherwise(F.slice("by_type", 1, 0)))
        status = F.when((F.size("blockers") == 0) & (F.col("candidates") > 0), "actionable").otherwise("diagnostic_only")
        warnings = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(why))) for c, why in (*WARNINGS, *((f.name, f.warning) for f in rule.flags))]))
        row = row.withColumns({"status": status, "predicted": F.col("candidates"), "warnings": warnings})
    row = row.withColumns(fixed)
    kinds = {f.name: f.dataType for f in row.schema}
    content = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), tagged(F.col(c), kinds[c])) for c in sorted(kinds)])
    return row.withColumn("plan_id", F.sha2(content, 256)).withColumn("salt_id", F.substring(F.sha2(F.lit(salt), 256), 1, 16)).withColumn("created", created)


#: what of a plan tells why it can't be acted on
DIAGNOSTICS = ("plan_id", "status", "rule", "rule_version", "gaps", "blockers", "schemas", "created")


def write_plan(record: DataFrame, folder: str) -> DataFrame:
    """Write the plan and its diagnostics as JSON below a folder, once; the plan as read back."""
    record.coalesce(1).write.mode("errorifexists").json(f"{folder}/plan")
    plan = record.sparkSession.read.schema(record.schema).json(f"{folder}/plan")
    plan.select(*DIAGNOSTICS).coalesce(1).write.mode("errorifexists").json(f"{folder}/diagnostics")
    return plan


def plan_drift(planned: DataFrame, found: DataFrame, rule: RuleSpec) -> DataFrame:
    """(identity, drift): planned identities that are no candidates now (gone) and new ones (new); empty if nothing moved."""
    one, two = planned.select(rule.identity, F.lit(True).alias("p")), found.select(rule.identity, F.lit(True).alias("f"))
    both = one.join(two, rule.identity, "full_outer").filter(F.col("p").isNull() | F.col("f").isNull())
    return both.select(rule.identity, F.when(F.col("f").isNull(), "gone").otherwise("new").alias("drift"))


CONFIRMED = ("predicted", "plan_id", "destination", "rollback_source")


def confirmation_check(plans: DataFrame, confirmations: DataFrame) -> DataFrame:
    """(session_id, confirmed, reason): a confirmation must equal its plan in every field; reason is the first that doesn't."""
    given = confirmations.select("session_id", F.lit(True).alias("given"), *[F.col(c).alias(f"c_{c}") for c in CONFIRMED])
    both = plans.join(given, "session_id", "left")
    reason = F.when(F.col("given").isNull(), "missing")
    for c in CONFIRMED:
        reason = reason.when(differs(F.col(c), F.col(f"c_{c}")), c)
    return both.select("session_id", reason.isNull().alias("confirmed"), reason.alias("reason"))


def report_metrics(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, metric, value): tables of (metric, n) under a section each, as text."""
    found = None
    for name in sorted(sections):
        one = sections[name].select(F.lit(name).alias("section"), "metric", shown(F.col("n")).alias("value"))
        found = one if found is None else found.union(one)
    return found
