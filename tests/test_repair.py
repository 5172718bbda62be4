"""The golden distribution: 227 candidates, what happens to them, and what stops a repair."""

import dataclasses
import datetime

import pytest
from pyspark.sql import functions as F

from driftmend.operators.classify import BEFORE_BLOCKERS, analysis_counts, audit_conflicts, candidates, candidates_by_type, classify, duplicate_naturals, unpivoted
from driftmend.operators.digest import changed_tables, table_digest
from driftmend.operators.inventory import publish_gates
from driftmend.operators.repair import repair, repair_gates, verdict
from driftmend.plans.plan import plan_drift, plan_record, report_metrics, write_plan
from driftmend.plans.rules import MESSAGE_RULE as RULE
from driftmend.sources.publish import GateError, apply_plan, publish_path, write_audit_publish, write_report, write_table
from driftmend.sources.snapshots import SnapshotPair, read_pair, read_tables

# Fixed values: (old type, rows, of which text differs, of which metadata differs)
GOLDEN = [(0, 211, 211, 129), (1, 6, 5, 6), (112, 4, 0, 4), (2, 3, 3, 3), (3, 2, 2, 2), (14, 1, 0, 1)]
MESSAGE = "msg_pk long, msg_id string, chat_pk long, sender_pk long, ts timestamp, content_type int, txt string, meta string, thumb string"
T0 = datetime.datetime(2026, 1, 1)


def golden(spark, extra_old=(), extra_current=(), chats=(("c1",),)):
    old, cur, k = [], [], 0
    for kind, n, texts, metas in GOLDEN:
        for i in range(n):
            k += 1
            text, meta = (f"t{k}" if i < texts else None), (f"m{k}" if i < metas else None)
            old.append((k, f"id{k}", 1, 1, T0, kind, text, meta, None))
            cur.append((k + 1000, f"id{k}", 1001, 1001, T0, 106, None, None, None))
    for i in range(21):
        old.append((5000 + i, f"p{i}", 1, 1, T0, 106, None, None, None))
        cur.append((6000 + i, f"p{i}", 1001, 1001, T0, 106, None, None, None))
    old.append((7000, "only-old", 1, 1, T0, 0, "x", None, None))
    cur += [(8000 + i, f"new{i}", 1001, 1001, T0, 0, "y", None, None) for i in range(5)]
    dims = lambda pk: {"chat": spark.createDataFrame([(pk + i, c[0]) for i, c in enumerate(chats)], "chat_pk long, chat_mid string"), "user": spark.createDataFrame([(pk, "u1"), (pk + 1, "u2")], "user_pk long, user_mid string")}
    return SnapshotPair({"message": spark.createDataFrame(old + list(extra_old), MESSAGE), **dims(1)}, {"message": spark.createDataFrame(cur + list(extra_current), MESSAGE), **dims(1001)})


def planned_record(pair, tmp_path):
    return write_plan(plan_record(pair, RULE, "salt", F.lit("now")), str(tmp_path / "plan"))


def counted(pair, compare="value"):
    return analysis_counts(classify(pair, RULE, compare), RULE).first().asDict()


@pytest.mark.parametrize("compare", ["value", "digest"])
def test_golden_counts(spark, compare):
    pair = golden(spark)
    n = counted(pair, compare)
    assert (n["candidates"], n["text_differences"], n["metadata_differences"], n["preserved_placeholders"], n["old_only"], n["current_only"]) == (227, 221, 145, 21, 1, 5)
    found = candidates(classify(pair, RULE, compare), RULE)
    assert {(r["old_type"], r["n"]) for r in candidates_by_type(found).collect()} == {(g[0], g[1]) for g in GOLDEN}


def test_repaired_equals_expected(spark, tmp_path):
    pair = golden(spark)
    planned = candidates(classify(pair, RULE), RULE)
    plan = planned_record(pair, tmp_path)
    done = apply_plan(pair, plan, planned, RULE, str(tmp_path / "staging"), str(tmp_path / "final"))["message"]
    state = spark.read.json(str(tmp_path / "final" / "_state")).first()
    assert (state["state"], state["n_rows"], state["failed_gates"], state["plan_id"]) == ("verified", done.count(), [], plan.first()["plan_id"])
    assert state["digest"] == table_digest(done).first()["digest"] and not (tmp_path / "staging").exists()
    assert set(read_tables(spark, str(tmp_path / "final"), ["message", "chat", "user"])) == {"message", "chat", "user"}
    was = pair.old["message"].select("msg_id", *[F.col(c).alias(f"o_{c}") for c in RULE.authorized])
    wrong = done.join(was, "msg_id").filter(" or ".join(f"not ({c} <=> o_{c})" for c in RULE.authorized))
    assert wrong.count() == 0
    assert done.filter("content_type = 106").count() == 21
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_table(done, str(tmp_path / "final"))
    with pytest.raises(GateError, match="export_conflict"):
        apply_plan(pair, plan, planned, RULE, str(tmp_path / "staging"), str(tmp_path / "final"))
    apply_plan(pair, plan, planned, RULE, str(tmp_path / "staging"), str(tmp_path / "final"), overwrite=True)


def test_stale_plans_write_nothing(spark, tmp_path):
    pair = golden(spark)
    planned, plan = candidates(classify(pair, RULE), RULE), planned_record(pair, tmp_path)
    side = lambda d, name, f: d | {name: f(d[name])}
    blank = lambda d: d.withColumn("meta", F.lit("x"))
    twice = pair.current["chat"].union(pair.current["chat"].withColumn("chat_pk", F.col("chat_pk") + 50))
    stale = [
        (pair, plan.withColumn("predicted", F.lit(226)), planned, RULE, "plan_drift"),
        (pair, plan, planned.filter("msg_id <> 'id7'"), RULE, "plan_drift"),
        (pair, plan.withColumn("status", F.lit("diagnostic_only")), planned, RULE, "not_actionable"),
        (pair, plan, planned, dataclasses.replace(RULE, version="0"), "plan_invalidated"),
        (SnapshotPair(side(pair.old, "message", blank), pair.current), plan, planned, RULE, "plan_invalidated"),
        (SnapshotPair(pair.old, pair.current | {"chat": twice}), plan, planned, RULE, "plan_invalidated"),
        (SnapshotPair(pair.old, side(pair.current, "user", lambda d: d.drop("user_mid"))), plan, planned, RULE, "plan_invalidated"),
    ]
    for given, record, ids, rule, code in stale:
        with pytest.raises(GateError) as e:
            apply_plan(given, record, ids, rule, str(tmp_path / "staging"), str(tmp_path / "final"))
        assert e.value.code == code and not (tmp_path / "staging").exists() and not (tmp_path / "final").exists()


def test_drifted_row_is_not_repaired(spark):
    pair = golden(spark)
    planned = candidates(classify(pair, RULE), RULE)
    moved = SnapshotPair(pair.old, pair.current | {"message": pair.current["message"].withColumn("content_type", F.when(F.col("msg_id") == "id7", 0).otherwise(F.col("content_type")))})
    now = candidates(classify(moved, RULE), RULE)
    assert [tuple(r) for r in plan_drift(planned, now, RULE).collect()] == [("id7", "gone")]
    assert repair(moved, RULE, planned).filter("msg_id = 'id7'").first()["txt"] is None


def damaged(name, f):
    return lambda tables: tables | {name: f(tables[name])}


def row(f):
    return damaged("message", f)


@pytest.mark.parametrize(
    ("tamper", "failed"),
    [
        (row(lambda d: d.withColumn("thumb", F.when(F.col("msg_id") == "p3", F.lit("z")).otherwise(F.col("thumb")))), "protected fields"),
        (row(lambda d: d.withColumn("txt", F.when(F.col("msg_id") == "id9", F.lit("z")).otherwise(F.col("txt")))), "repaired fields"),
        (row(lambda d: d.withColumn("content_type", F.when(F.col("msg_id") == "id9", 106).otherwise(F.col("content_type")))), "remaining candidates,repaired fields"),
        (row(lambda d: d.filter("msg_id <> 'p3' or msg_id is null")), "row count,row set"),
        (row(lambda d: d.withColumn("msg_pk", F.when(F.col("msg_id") == "p3", F.lit(99999)).otherwise(F.col("msg_pk")))), "row set"),
        (row(lambda d: d.union(d.filter("msg_id = 'p3'"))), "row count"),
        (damaged("user", lambda d: d.withColumn("user_mid", F.when(F.col("user_pk") == 1001, "renamed").otherwise(F.col("user_mid")))), "unrelated tables"),
        (damaged("chat", lambda d: d.union(d)), "repaired fields,unrelated tables"),
        (damaged("chat", lambda d: d.withColumnRenamed("chat_mid", "mid").withColumn("chat_mid", F.col("mid"))), "unrelated tables"),
        (lambda tables: tables | {"more": tables["user"]}, "table set,unrelated tables"),
        (lambda tables: {k: v for k, v in tables.items() if k != "user"}, "table set,unrelated tables"),
    ],
)
def test_each_gate_trips(spark, tamper, failed):
    pair = golden(spark)
    planned = candidates(classify(pair, RULE), RULE)
    good = pair.current | {"message": repair(pair, RULE)}
    assert verdict(repair_gates(pair, tamper(good), planned, RULE)).first()["failed"] == failed


def test_what_fails_is_not_published(spark, tmp_path):
    pair = golden(spark)
    planned = candidates(classify(pair, RULE), RULE)
    tables = pair.current | {"message": repair(pair, RULE).filter("msg_id <> 'p3' or msg_id is null")}
    write = lambda **k: write_audit_publish(tables, "message", str(tmp_path / "s"), str(tmp_path / "f"), lambda x: repair_gates(pair, x, planned, RULE), **k)
    with pytest.raises(GateError):
        write()
    state = spark.read.json(str(tmp_path / "s.state")).first()
    assert state["state"] == "unverified" and state["failed_gates"] == ["row count", "row set"] and not (tmp_path / "f").exists() and not (tmp_path / "s").exists()
    write(plan_id="p", keep_unverified=True)
    state = spark.read.json(str(tmp_path / "f" / "_state")).first()
    assert (state["state"], state["plan_id"], state["failed_gates"]) == ("unverified", "p", ["row count", "row set"]) and (tmp_path / "f" / "message").exists()


def test_publish_gates_trip(spark):
    rows = [(f"p{i}", i, f"h{i}") for i in range(5)]
    at = lambda changed, gone=(): spark.createDataFrame([(p, n, "other" if p in changed else h) for p, n, h in rows if p not in gone], "path string, size long, hash string")
    approved = spark.createDataFrame([("p1",)], "path string")
    failed = lambda later, clone: verdict(publish_gates(at(()), later, clone, approved)).first()["failed"]
    assert failed(at(()), at(("p1",))) == ""
    assert failed(at(("p2",)), at(("p1",))) == "source unchanged"
    assert failed(at(()), at(("p1", "p2"))) == "only approved differences"
    assert failed(at(()), at(("p1",), ("p4",))) == "files,only approved differences"


def test_conflicts_duplicates_and_nulls(spark):
    late = T0 + datetime.timedelta(seconds=1)
    old = [(9000, "ts", 1, 1, T0, 0, "a", None, None), (9001, "chat", 1, 1, T0, 0, "a", None, None), (9002, None, 1, 1, T0, 0, "a", None, None), (9003, "dup", 1, 1, T0, 0, "a", None, None), (9004, "nokind", 1, 1, T0, None, "a", None, None), (9005, "sender", 1, 2, T0, 0, "a", None, None)]
    cur = [(9100, "ts", 1001, 1001, late, 106, None, None, None), (9101, "chat", 1002, 1001, T0, 106, None, None, None), (9102, None, 1001, 1001, T0, 106, None, None, None), (9103, "dup", 1001, 1001, T0, 106, None, None, None), (9104, "dup", 1001, 1001, T0, 106, None, None, None), (9105, "nokind", 1001, 1001, T0, 106, None, None, None), (9106, "sender", 1001, 1001, T0, 0, "a", None, None)]
    pair = golden(spark, old, cur, (("c1",), ("c2",)))
    n = counted(pair)
    assert (n["candidates"], n["timestamp_conflicts"], n["chat_conflicts"], n["null_ids_old"], n["null_ids_current"], n["duplicate_ids"], n["null_old_type"], n["residual_unclassified"]) == (227, 1, 1, 1, 1, 1, 1, 1)
    assert audit_conflicts(pair, RULE).first()[0] == 1
    fixed = repair(pair, RULE)
    assert fixed.filter("msg_id is null or msg_id in ('dup', 'ts', 'chat', 'nokind')").filter("content_type <> 106").count() == 0
    blocked = golden(spark, old, cur, (("c1",), ("c1",)))
    assert duplicate_naturals(blocked, RULE).count() == 2
    n = analysis_counts(classify(blocked, RULE), RULE, duplicate_naturals(blocked, RULE)).first().asDict()
    assert (n["null_ids_old"], n["duplicate_ids"], n["old_messages"]) == (1, 1, 255) and not any(v for k, v in n.items() if k not in BEFORE_BLOCKERS)
    plan = plan_record(blocked, RULE, "s", F.lit("t")).first()
    assert plan["status"] == "diagnostic_only" and plan["predicted"] == 0 and plan["by_type"] == [] and plan["blockers"] == ["current 1 repeated chat_mid", "old 1 repeated chat_mid"]


def test_unsupported_snapshots(spark, tmp_path):
    pair = golden(spark)
    odd = SnapshotPair(pair.old | {"message": pair.old["message"].drop("thumb", "ts")}, {k: v for k, v in pair.current.items() if k != "user"})
    plan = write_plan(plan_record(odd, RULE, "s", F.lit("t")), str(tmp_path)).first()
    assert plan["status"] == "unsupported" and plan["gaps"] == ["old:message.ts", "old:message.thumb", "current:user (table)"]
    assert spark.read.json(str(tmp_path / "diagnostics")).first()["gaps"] == plan["gaps"]


def test_pairs_and_names(spark, tmp_path):
    pair = golden(spark)
    for side in ("old", "current"):
        for name, table in getattr(pair, side).items():
            write_table(table, f"{tmp_path}/{side}/{name}")
    again = read_pair(spark, f"{tmp_path}/old", f"{tmp_path}/current", ["message", "chat", "user"])
    assert counted(again) == counted(pair)
    assert publish_path(spark, "x", "clone", "timestamp '2026-01-02 03:04:05'") == "x/clone-20260102-030405"
    write_report(report_metrics({"analysis": unpivoted(analysis_counts(classify(pair, RULE), RULE))}).withColumn("secret", F.lit("s")), str(tmp_path / "report"))
    assert set(spark.read.json(str(tmp_path / "report")).columns) == {"section", "metric", "value"}


def test_empty_snapshots(spark):
    pair = golden(spark)
    none = SnapshotPair({k: v.limit(0) for k, v in pair.old.items()}, {k: v.limit(0) for k, v in pair.current.items()})
    assert set(counted(none).values()) == {0}
    assert repair(none, RULE).count() == 0
    assert table_digest(none.old["message"]).first()["n_rows"] == 0


def test_digests_and_plan_ids(spark):
    pair = golden(spark)
    a, b = pair.old["message"], pair.old["message"].repartition(7)
    assert table_digest(a).first() == table_digest(b).first() != table_digest(a.union(a.limit(1))).first()
    assert table_digest(a, bucket=8).first() == table_digest(b, bucket=8).first()
    assert changed_tables({"x": a}, {"x": b, "y": a}).orderBy("table_name").collect() == [("x", False), ("y", True)]
    nested = "array<string>", "map<string,int>", "struct<a:string,b:string>"
    one = spark.createDataFrame([(["a, b"], {"k": 1, "j": 2}, ("x", None))], f"a {nested[0]}, m {nested[1]}, s {nested[2]}")
    two = spark.createDataFrame([(["a", "b"], {"j": 2, "k": 1}, ("x", ""))], one.schema)
    assert [table_digest(one.select(c)).first() == table_digest(two.select(c)).first() for c in "ams"] == [False, True, False]
    ids = [plan_record(p, RULE, salt, F.lit(t)).first() for p, salt, t in ((pair, "s1", "a"), (SnapshotPair(pair.old, pair.current | {"user": pair.current["user"].repartition(3)}), "s2", "b"))]
    assert ids[0]["plan_id"] == ids[1]["plan_id"] and ids[0]["salt_id"] != ids[1]["salt_id"] and ids[0]["status"] == "actionable" and ids[0]["predicted"] == 227
    other = plan_record(SnapshotPair(pair.old, pair.current | {"user": pair.current["user"].limit(1)}), RULE, "s1", F.lit("a")).first()
    assert other["plan_id"] != ids[0]["plan_id"]


def test_conflicts_of_much_repeated_identities(spark):
    """Copies under one identity, counted from the pairs themselves, and dealt into parts that are not put together again."""
    rows = lambda at, n: [(at + i, f"i{i % 3}" if i % 5 else None, 1, 1 + i % 2, T0, 0, None, None, None) for i in range(n)]
    users = spark.createDataFrame([(1, "u1"), (2, None)], "user_pk long, user_mid string")
    old, cur = rows(0, 60), rows(1000, 47)
    pair = SnapshotPair(*[{"message": spark.createDataFrame(r, MESSAGE), "user": users} for r in (old, cur)])
    found = audit_conflicts(pair, RULE)
    assert found.first()[0] == sum(a[1] == b[1] and a[3] != b[3] for a in old for b in cur if a[1] and b[1])
    assert found._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") > 0
