import heapq
import random

import pytest
from pyspark.sql import functions as F

from driftmend.llm.chat import _TURNS, FOLLOWS, INSERT, MERGE, NONE, RELABEL, START, UNKNOWN_ROLE, _number, repair, stretch, trace


def cheapest(given):
    """(cost, turns) by a search over all single actions."""
    best, queue = {(0, START): (0, 0)}, [(0, 0, 0, START)]
    while queue:
        cost, turns, i, s = heapq.heappop(queue)
        if i == len(given):
            return cost, turns
        if best[i, s] < (cost, turns):
            continue
        for role in range(3):
            label = 0 if role == given[i] else UNKNOWN_ROLE if given[i] == NONE else RELABEL
            steps = [(label + MERGE, 0)] if role == s else []
            steps += [(label, 1)] if role in FOLLOWS[s] else []
            steps += [(label + INSERT, 2) for x in FOLLOWS[s] if role in FOLLOWS[x]]
            for c, t in steps:
                if (cost + c, turns + t) < best.get((i + 1, role), (10**9, 0)):
                    best[i + 1, role] = (cost + c, turns + t)
                    heapq.heappush(queue, (cost + c, turns + t, i + 1, role))


def test_repairs_are_legal_and_cheapest():
    rng = random.Random(11)
    for _ in range(1500):
        given = [rng.choice([0, 1, 2, 1, 2, NONE]) for _ in range(rng.randrange(1, 9))]
        state, turns, cost = START, 0, 0
        for g, (role, merged, inserted) in zip(given, trace(given)):
            for x in inserted:
                assert x in FOLLOWS[state]
                state = x
            assert role == state if merged else role in FOLLOWS[state]
            turns += len(inserted) + (not merged)
            cost += INSERT * len(inserted) + MERGE * merged + (0 if g == role else UNKNOWN_ROLE if g == NONE else RELABEL)
            state = role
        weight = int(stretch(given)[START].min())
        assert (cost, turns) == cheapest(given) == (weight // _TURNS, weight % _TURNS)


def _check(found, n):
    assert len(found) == n
    for _, g in found.groupby("conv_id"):
        weight = int(stretch([_number(r) for r in g["role"]])[START].min())
        assert (g["cost"].sum(), g["out_turn"].max() + 1) == (weight // _TURNS, weight % _TURNS)
        assert g["position"].tolist() == list(range(len(g))) and g["turn"].is_monotonic_increasing
        assert "".join(g["rendered"]).count("<|") == weight % _TURNS


@pytest.mark.parametrize("kind", ["long", "string", "smallint"])
def test_a_conversation_over_many_blocks(spark, kind):
    rng = random.Random(12)
    roles = ["system", "user", "assistant", "tool", None, "User "]
    rows = [(1 if rng.random() < 0.8 else rng.randrange(2, 40), i, rng.choice(roles), f"t{i}") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("conv_id", F.col("conv_id").cast(kind))
    found = repair(turns, block=100)
    assert found.schema["conv_id"].dataType == turns.schema["conv_id"].dataType
    _check(found.toPandas().sort_values(["conv_id", "position"]), 3000)


def test_files_may_be_split_otherwise_when_read_again(spark):
    rng = random.Random(14)
    turns = spark.createDataFrame([(1, i, rng.choice(["user", "assistant", "tool"]), "x" * 40) for i in range(30_000)], "conv_id long, turn long, role string, text string").repartition(2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        found = repair(turns)
        for k in old:
            spark.conf.set(k, "8k")
        _check(found.toPandas().sort_values(["conv_id", "position"]), 30_000)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        for k, v in old.items():
            spark.conf.set(k, v)
