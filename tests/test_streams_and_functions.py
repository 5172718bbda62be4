"""Streams agree with their batch forms; column functions with known values."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftmend.functions.columns import padded_length, public_id, rfc3339, tagged
from driftmend.functions.privacy import privacy_scan, redacted, sensitive_identifiers
from driftmend.operators.ledger import stage_states
from driftmend.operators.payload import decrypted, encrypted
from driftmend.plans.rules import MESSAGE_RULE as RULE
from driftmend.queries import _pair, candidates
from driftmend.sources.derived import LEDGER, SNAPSHOTS, derived
from driftmend.sources.directories import dir_manifest, header_check
from driftmend.streaming.changes import candidate_stream, stage_state_stream


def plain_fold(rows):
    now = {}
    for session, _, stage, kind in sorted(rows, key=lambda r: (r[0], r[1])):
        s = now.setdefault(session, {})
        if kind == "commit":
            if s.get(stage) == "running":
                s[stage] = "committed"
        else:
            s[stage] = {"begin": "running", "fail": "failed", "cancel": "cancelled"}[kind]
            if kind == "begin":
                for k in s:
                    if k > stage:
                        s[k] = "invalidated"
    return {(a, b, v) for a, s in now.items() for b, v in s.items()}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(stream, name, batches, folder):
    """The last told state and late events of each session and stage, after batches of rows."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode("update").start()
    try:
        for batch in batches:
            batch.coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
    finally:
        query.stop()
    return {(r["session_id"], r["stage"]): (r["state"], r["late"]) for r in spark.table(name).collect()}


def test_ledger_batch_and_stream(spark, sf, tmp_path, rocks):
    """Events of all sessions, dealt to three triggers by hash: those of a session come in no order, and some twice."""
    events = derived(spark, sf, LEDGER, "events_log")
    want = plain_fold([tuple(r) for r in events.select("session_id", "seq", "stage", "kind").collect()])
    assert {tuple(r) for r in stage_states(events).drop("holds").collect()} == want
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    parts = [events.filter(F.pmod(F.hash("seq"), F.lit(3)) == k).orderBy(F.desc("seq")) for k in range(3)]
    last = run(stage_state_stream(source, block=64), "states", [parts[0], parts[1].union(parts[0].limit(50)), parts[2]], str(tmp_path / "in"))
    assert {(a, b, v) for (a, b), (v, _) in last.items() if v != "pending"} == want and {n for _, n in last.values()} == {0}


class Memory:
    """A processor's state and timers, held here."""

    def __init__(self):
        self.held, self.timers, self.now = {}, [], 0

    getMapState = lambda self, *_: self
    getValue = lambda self, k: self.held[k]
    containsKey = lambda self, k: k in self.held
    iterator = lambda self: iter(self.held.items())
    listTimers = lambda self: iter(self.timers)
    getCurrentProcessingTimeInMs = lambda self: self.now

    def updateValue(self, k, v):
        self.held[k] = v

    def registerTimer(self, at):
        self.timers.append(at)


def test_settled_blocks(spark):
    """A closed block keeps what its events came to; what comes later is counted, and open blocks still take any order."""
    import pandas as pd

    from driftmend.streaming.changes import LedgerFold

    memory = Memory()
    fold = LedgerFold(10, 100)
    fold.init(memory)
    rows = lambda *r: iter([pd.DataFrame(r, columns=["seq", "stage", "kind"])])
    told = lambda *r: [tuple(x) for f in fold.handleInputRows((1,), rows(*r), memory) for x in f[["state", "late"]].itertuples(index=False)]
    assert told((3, 0, "commit"), (2, 0, "begin"))[0] == ("committed", 0)
    memory.now = 90
    assert told((15, 1, "commit"))[1] == ("pending", 0) and memory.timers == [100]
    memory.now, memory.timers = 100, []
    assert list(fold.handleExpiredTimer((1,), memory, None)) == [] and memory.timers == [190]
    assert memory.held[(0,)][0] is None and memory.held[(1,)][0] == [15]
    assert told((1, 0, "fail"), (14, 1, "begin"))[:2] == [("committed", 1), ("committed", 1)]
    memory.now = 500
    fold.handleExpiredTimer((1,), memory, None)
    assert all(v[0] is None for v in memory.held.values()) and told((25, 0, "begin"))[:2] == [("running", 1), ("invalidated", 1)]


def test_blocks_close_in_a_running_stream(spark, tmp_path, rocks):
    import time

    schema = "session_id long, seq long, stage int, kind string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    add = lambda *r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = stage_state_stream(source, block=10, settle_ms=200).writeStream.format("memory").queryName("closing").outputMode("update").start()
    state = lambda: {(r["state"], r["late"]) for r in spark.table("closing").filter("stage = 0").collect()}

    def until(met):
        end = time.monotonic() + 60
        while not met() and time.monotonic() < end:
            time.sleep(0.2)
        assert met()

    try:
        add((1, 2, 0, "begin"), (1, 3, 0, "commit"))
        until(lambda: ("committed", 0) in state())
        time.sleep(6)  # triggers without rows let the timer expire
        add((1, 4, 0, "fail"), (1, 30, 1, "begin"))
        until(lambda: len(state()) > 1)
        assert state() == {("committed", 0), ("committed", 1)}
    finally:
        query.stop()


def test_candidate_stream(spark, sf, tmp_path):
    cur = derived(spark, sf, SNAPSHOTS, "cur_msg").join(derived(spark, sf, SNAPSHOTS, "cur_chat"), "chat_pk", "left").withColumnRenamed("chat_mid", "chat_key")
    old = derived(spark, sf, SNAPSHOTS, "old_msg").join(derived(spark, sf, SNAPSHOTS, "old_chat"), "chat_pk", "left").withColumnRenamed("chat_mid", "chat_key")
    cur.write.parquet(str(tmp_path / "in"))
    stream = candidate_stream(spark.readStream.schema(cur.schema).parquet(str(tmp_path / "in")), old, RULE).writeStream.format("memory").queryName("cands").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    want = {r["msg_id"] for r in candidates(spark, sf).collect()}
    assert want <= {r["msg_id"] for r in spark.table("cands").collect()}
    assert _pair(spark, sf).old["message"].count() > 0


def test_columns(spark):
    row = spark.range(1).select(
        rfc3339(F.lit("2026-03-04 05:06:07").cast("timestamp"), -90).alias("t"), padded_length(F.lit(16)).alias("p"), public_id(F.lit("s"), F.lit("id")).alias("i"),
        tagged(F.lit("é"), "string").alias("a"), tagged(F.lit(None).cast("string"), "string").alias("n"), tagged(F.lit(b"x"), "binary").alias("b"),
    ).first()
    assert row["t"] == "2026-03-04T03:36:07-01:30" and row["p"] == 32 and len(row["i"]) == 16
    assert row["a"] == "T2:é" and row["n"] == "N;" and row["b"] == "B2:78"


def test_wrong_key_restores_nothing(spark):
    key = lambda b: F.unhex(F.lit(bytes([b] * 32).hex()))
    row = spark.range(1).select(encrypted(F.lit(b"payload"), key(1)).alias("c")).select(decrypted(F.col("c"), key(1)).alias("ok"), decrypted(F.col("c"), key(2)).alias("no"), decrypted(F.substring("c", 1, 7), key(1)).alias("cut")).first()
    assert row["ok"] == b"payload" and row["no"] != b"payload" and row["cut"] is None


def test_redaction(spark):
    """Against plain replacement of the longest identifiers first, and plain containment."""
    rng = random.Random(41)
    known = sorted({"".join(rng.choice("ab c😀") for _ in range(rng.randrange(8, 14))) for _ in range(40)} | {"aaaaaaaa", "aaaaaaaaaa", "Customer#000000001", "Customer#000000002", "UNITED KINGDOM"})
    texts = ["", None, "short", "from UNITED KINGDOM", "dir/xCustomer#000000001abc", "Customer#000000002.Customer#000000001", "z" * 3000 + known[3] + "z" * 3000, "a" * 37]
    for _ in range(300):
        texts.append("".join(rng.choice([rng.choice(known), rng.choice("ab c😀"), rng.choice(known)[2:7]]) for _ in range(rng.randrange(0, 12))))
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    report = spark.createDataFrame(rows, "k long, txt string")
    names = sensitive_identifiers([(spark.createDataFrame([(n,) for n in [*known, "short", None]], "n string"), "n")])

    def plain(t):
        taken = []
        for name in sorted(known, key=lambda n: -len(n)):
            places = [m for m in range(len(t)) if t.startswith(name, m)]
            taken.append((name, places))
        free, spans = [True] * len(t), []
        for size in sorted({len(n) for n, _ in taken}, reverse=True):
            for at, name in sorted((m, n) for n, ms in taken if len(n) == size for m in ms):
                if all(free[at : at + size]):
                    free[at : at + size] = [False] * size
                    spans.append((at, size, name))
        for at, size, name in sorted(spans, reverse=True):
            t = t[:at] + "redacted:" + hashlib.sha256(f"s|{name}".encode()).hexdigest()[:12] + t[at + size :]
        return t

    done = redacted(report, "txt", names, "s")
    assert sorted(map(repr, [tuple(r) for r in done.collect()])) == sorted(map(repr, [(k, t if t is None else plain(t)) for k, t in rows]))
    assert privacy_scan(report, "txt", names).first()["leaks"] == sum(t is not None and any(n in t for n in known) for _, t in rows)
    assert tuple(privacy_scan(done, "txt", names).first()) == (0, len(rows)) and tuple(privacy_scan(report, "txt", names.limit(0)).first()) == (0, len(rows))
    assert privacy_scan(report, "txt", names, shard=7).first() == privacy_scan(report, "txt", names).first()  # many automata


def test_a_text_of_one_repeated_identifier(spark):
    """A megabyte of hits that all overlap takes time in proportion."""
    import time

    import pyarrow as pa

    from driftmend.functions.privacy import _settled

    took = []
    for n in (100_000, 800_000):
        hits = pa.array([[{"start": i, "stop": i + 8, "identifier": "a" * 8} for i in range(n)]])
        began = time.process_time()
        (kept,) = _settled(hits).to_pylist()
        took.append(time.process_time() - began)
        assert [k["start"] for k in kept] == list(range(0, n - 7, 8))[: len(kept)] and len(kept) == -(-n // 8)
    assert took[1] < 20 * max(took[0], 0.05)
    report = spark.createDataFrame([(1, "a" * 50_000)], "k long, txt string")
    names = spark.createDataFrame([("a" * 8,)], "identifier string")
    (row,) = redacted(report, "txt", names, "s").collect()
    assert row["txt"].count("redacted:") == 50_000 // 8 and "aaaaaaaa" not in row["txt"]


def test_a_long_session(spark):
    """One session over many blocks."""
    rng = random.Random(42)
    rows = [(1, i, rng.randrange(6), rng.choice(["begin", "commit", "commit", "fail", "cancel"])) for i in range(5000)]
    events = spark.createDataFrame(rows, "session_id long, seq long, stage int, kind string")
    for n in (1, 50, 4000):
        part = events.filter(F.col("seq") < n)
        assert {tuple(r) for r in stage_states(part, block=64).drop("holds").collect()} == plain_fold(rows[:n])


def test_directories(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"MAGIC and more")
    (tmp_path / "d" / "b").write_bytes(b"other")
    found = {r["path"][-1]: r for r in dir_manifest(spark, str(tmp_path)).collect()}
    assert found["a"]["size"] == 14 and len(found["b"]["hash"]) == 64 and found["a"]["problem"] is None
    assert {r["path"][-1]: r["ok"] for r in header_check(spark, str(tmp_path), b"MAGIC").collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_entry_point(spark, name):
    import __spark_entry__ as e

    found = getattr(e, name)(spark) if name == "entry" else getattr(e, name)()
    assert found.count() == 1 if name == "entry" else len(found) > 50


def test_gates_and_cleanup(spark):
    """Every need of patching blocks it; verification is never begun by hand; sessions without events get intake."""
    from driftmend.operators.ledger import GATES, cleanup_set, stage_gate

    events = spark.createDataFrame([(s, i, stage, kind) for s in (1, 2, 3) for i, (stage, kind) in enumerate([(0, "begin"), (0, "commit"), (1, "begin"), (1, "commit"), (4, "begin"), (4, "commit")])] + [(3, 9, 0, "begin")], "session_id long, seq long, stage int, kind string")
    states = stage_states(events)
    flags = [(0, "old_intake"), (0, "current_intake"), (0, "current_patchable"), (1, "plan_actionable"), (None, "destination_selected"), (None, "review_acknowledged"), (None, "count_typed"), (None, "confirmed"), (4, "verified")]
    session = lambda n: spark.createDataFrame([(n,)], "session_id long")
    evidence = lambda n, without=(): spark.createDataFrame([(n, s, f, f not in without) for s, f in flags], "session_id long, stage int, flag string, value boolean")
    gate = lambda n, e: {r["stage"]: (r["can_run"], r["blockers"]) for r in stage_gate(session(n), states, e).collect()}
    assert gate(1, evidence(1)) == {k: (k != 4, "runs by itself after patching" if k == 4 else "") for k in GATES}
    for need in GATES[3][1:]:
        assert gate(1, evidence(1, need.flag))[3] == (False, need.reason)
    assert {k for k, (can, _) in gate(7, evidence(1)).items() if can} == {0} and gate(7, evidence(1))[3][1].count(",") == 6
    assert not any(can for can, _ in gate(3, evidence(3)).values()) and all(b.startswith("an operation is running") for _, b in gate(3, evidence(3)).values())
    outputs = spark.createDataFrame([(s, k, f"{s}/{k}", 1, True) for s in (1, 3) for k in (0, 1, 4)] + [(1, 1, "plain", 1, False)], "session_id long, stage int, path string, size long, sensitive boolean")
    # stage 0 of session 3 was begun again, which clears it; later stages are invalidated and keep what they have
    assert {r["path"] for r in cleanup_set(outputs, states).collect()} == {"1/0", "1/1", "1/4", "3/1", "3/4"}


def test_a_rule_is_chosen_by_what_the_tables_have(spark, sf):
    from driftmend.plans.plan import analyse, select_rule
    from driftmend.plans.rules import ORDER_RULE, RULES
    from driftmend.queries import _orders
    from driftmend.sources.snapshots import SnapshotPair

    messages, orders = _pair(spark, sf), _orders(spark, sf)
    assert [select_rule(p, RULES)[0].id for p in (messages, orders)] == [RULE.id, ORDER_RULE.id]
    both = SnapshotPair(messages.old | orders.old, messages.current | orders.current)
    assert select_rule(both, RULES) == (RULE, {})
    lacking = SnapshotPair(orders.old, orders.current | {"buyer": orders.current["buyer"].drop("buyer_name")})
    assert select_rule(lacking, RULES) == (None, {RULE.id: [f"{s}:{t} (table)" for s in ("old", "current") for t in ("message", "chat", "user")], ORDER_RULE.id: ["current:buyer.buyer_name"]})
    rule, plan = analyse(lacking, RULES, "s", F.lit("t"))
    assert rule is None and plan.first()["status"] == "unsupported" and "order-price: current:buyer.buyer_name" in plan.first()["gaps"]
