"""Write, audit, publish: results become visible only once their gates pass on what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmend.operators.classify import candidates, classify, duplicate_naturals
from driftmend.operators.digest import table_digest
from driftmend.operators.repair import repair, repair_gates, verdict
from driftmend.plans.plan import input_digests, plan_drift, snapshot_gaps
from driftmend.plans.rules import RuleSpec
from driftmend.sources.snapshots import SnapshotPair, read_tables

VERIFIED, UNVERIFIED = "verified", "unverified"


class GateError(Exception):
    """A write that isn't published; code says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def _place(spark: SparkSession, path: str):
    """(file system, path) of a place that Spark can write to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _there(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _drop(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; onto what is there already it fails."""
    files, place = _place(spark, source)
    to = _place(spark, target)[1]
    files.mkdirs(to.getParent())
    if files.exists(to) or not files.rename(place, to):
        raise GateError("publish_failed", f"{source} can't be moved to {target}")


def _note(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a text, in one piece: written beside its place and renamed."""
    files, place = _place(spark, path + ".new")
    out = files.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    _drop(spark, path)
    _move(spark, path + ".new", path)


def write_table(table: DataFrame, path: str, overwrite: bool = False, form: str = "parquet") -> None:
    """Write a table; one that is there already is replaced only if that is asked for."""
    table.write.format(form).mode("overwrite" if overwrite else "errorifexists").save(path)


#: the state of published tables lies in their own folder, so that it comes and goes with them
STATE = "_state"


def read_state(spark: SparkSession, final: str) -> dict | None:
    """What is published at a place: state, plan_id, n_rows, digest and failed_gates; None if nothing is."""
    return spark.read.json(f"{final}/{STATE}").first().asDict() if _there(spark, final) else None


def recover(spark: SparkSession, final: str) -> str | None:
    """Finish or take back a publication that was broken off: new or old says which of them final holds, None that there was none.

    While one goes on, final.pending is there. If the new output had been moved to final it stays and what it replaced goes; else
    what had been set aside comes back.
    """
    pending, aside, staged = f"{final}.pending", f"{final}.aside", f"{final}.staged"
    if not _there(spark, pending):
        return None
    if not _there(spark, staged) and _there(spark, final):
        told = "new"
        _drop(spark, aside)
    else:
        told = "old"
        if _there(spark, aside) and not _there(spark, final):
            _move(spark, aside, final)
        _drop(spark, staged)
    _drop(spark, pending)
    return told


def _replace(spark: SparkSession, staging: str, final: str, after: Callable[[str], None]) -> None:
    """Put staging in the place of final: a note of what goes on, old output aside, new output in, and the note's removal as the commit.

    After an error final holds what it held before, or the new output if that was in place; after a crash recover does the same.
    """
    moved = False
    try:
        _move(spark, staging, f"{final}.staged")
        after("staged")
        _note(spark, f"{final}.pending", staging)
        after("noted")
        if _there(spark, final):
            _move(spark, final, f"{final}.aside")
        after("set aside")
        _move(spark, f"{final}.staged", final)
        moved = True
        after("moved")
        _drop(spark, f"{final}.aside")
        after("cleared")
        _drop(spark, f"{final}.pending")
        after("committed")
    except Exception as e:
        recover(spark, final)
        _drop(spark, f"{final}.staged")
        if not moved:
            raise GateError("publish_failed", f"{final} holds what it held before: {e}") from e


def write_audit_publish(
    tables: dict[str, DataFrame], main: str, staging: str, final: str, audit: Callable[[dict[str, DataFrame]], DataFrame], plan_id: str | None = None, overwrite: bool = False, keep_unverified: bool = False,
    after: Callable[[str], None] = lambda step: None,
) -> dict[str, DataFrame]:
    """Write tables to staging, read them back, audit, and move the audited files to final; the tables there.

    Their folder has a JSON row _state with the state, plan_id, the rows and digest of the main table, and the failed gates: it is
    written before the move and moves with the files, so that none says verified without them. If a gate fails nothing
    is published and GateError raised: staging is dropped, so that a retry starts clean, and staging.state says which gates
    failed. With keep_unverified the files go to final all the same, as unverified. What final holds already is replaced only with
    overwrite, and comes back if the replacement fails; a publication broken off by a crash is settled first (recover).
    Staging and final share a file system. after: called with the name of each step of the move.
    """
    spark = tables[main].sparkSession
    recover(spark, final)
    if _there(spark, final) and not overwrite:
        raise GateError("export_conflict", f"{final} is there already")
    _drop(spark, staging)
    _drop(spark, f"{final}.staged")
    for name, table in tables.items():
        write_table(table, f"{staging}/{name}", overwrite=True)
    staged = read_tables(spark, staging, list(tables))
    told = verdict(audit(staged)).first()
    state = table_digest(staged[main]).select(
        F.lit(VERIFIED if told["passed"] else UNVERIFIED).alias("state"), F.lit(plan_id).cast("string").alias("plan_id"), "n_rows", "digest", F.split(F.lit(told["failed"]), ",").alias("failed_gates")
    )
    state = state.withColumn("failed_gates", F.filter("failed_gates", lambda g: g != ""))
    if not told["passed"] and not keep_unverified:
        write_table(state.coalesce(1), f"{staging}.state", True, "json")
        _drop(spark, staging)
        raise GateError("gates_failed", told["failed"])
    write_table(state.coalesce(1), f"{staging}/{STATE}", True, "json")
    _replace(spark, staging, final, after)
    return read_tables(spark, final, list(tables))


def revalidate(pair: SnapshotPair, plan: DataFrame, planned: DataFrame, rule: RuleSpec) -> str:
    """The plan's id, if it still holds for the pair as it is now; else GateError.

    The status, rule and version, the digests of all inputs, blockers, and the set and number of candidates are checked.
    planned: the candidates that the plan was made from, which plans don't hold.
    """
    row = plan.first()
    if row["status"] != "actionable":
        raise GateError("not_actionable", row["status"])
    if (row["rule"], row["rule_version"]) != (rule.id, rule.version):
        raise GateError("plan_invalidated", f"made with rule {row['rule']} version {row['rule_version']}")
    if gaps := snapshot_gaps(pair, rule):
        raise GateError("plan_invalidated", f"inputs now lack {', '.join(gaps)}")
    if blocking := duplicate_naturals(pair, rule).select("relationship").distinct().collect():  # one row for each relationship at most
        raise GateError("plan_invalidated", f"inputs now have repeated natural keys of {', '.join(sorted(r[0] for r in blocking))}")
    was = {(x["side"], x["table_name"]): x["digest"] for x in row["inputs"]}
    now = {(x["side"], x["table_name"]): x["digest"] for x in input_digests(pair).collect()}
    if was != now:
        raise GateError("plan_invalidated", "inputs changed: " + ", ".join(":".join(k) for k in sorted(was.keys() | now.keys()) if was.get(k) != now.get(k)))
    found = candidates(classify(pair, rule), rule)
    if not plan_drift(planned, found, rule).isEmpty() or found.count() != row["predicted"]:
        raise GateError("plan_drift", f"the candidates aren't the {row['predicted']} that were predicted")
    return row["plan_id"]


def apply_plan(pair: SnapshotPair, plan: DataFrame, planned: DataFrame, rule: RuleSpec, staging: str, final: str, overwrite: bool = False, keep_unverified: bool = False) -> dict[str, DataFrame]:
    """All or nothing: if the plan still holds, repair the planned rows, and publish all tables if all gates pass."""
    plan_id = revalidate(pair, plan, planned, rule)
    tables = pair.current | {rule.table: repair(pair, rule, planned)}
    return write_audit_publish(tables, rule.table, staging, final, lambda staged: repair_gates(pair, staged, planned, rule), plan_id, overwrite, keep_unverified)


def publish_path(spark: SparkSession, folder: str, name: str, at: str = "current_timestamp()") -> str:
    """A place for published output that its time tells from others: folder/name-yyyyMMdd-HHmmss."""
    return f"{folder}/{name}-{spark.range(1).select(F.date_format(F.expr(at), 'yyyyMMdd-HHmmss')).first()[0]}"


def write_report(report: DataFrame, path: str, columns: tuple[str, ...] = ("section", "metric", "value")) -> None:
    """Write the report as JSON, with whitelisted columns only."""
    report.select(*columns).coalesce(1).write.mode("errorifexists").json(path)
