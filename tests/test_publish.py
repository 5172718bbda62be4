"""A publication that fails or is broken off after any step leaves the old or the new output, and never a state without files."""

import pytest
from pyspark.sql import functions as F

from driftmend.sources.publish import GateError, read_state, recover, write_audit_publish
from driftmend.sources.snapshots import read_tables

STEPS = ["staged", "noted", "set aside", "moved", "cleared", "committed"]


class Crash(BaseException):
    """As if the driver were gone: nothing is tidied up."""


def passing(tables):
    n = next(iter(tables.values())).sparkSession
    return n.createDataFrame([("rows", 0, 0, True)], "gate string, observed long, expected long, passed boolean")


def publish(spark, tmp_path, value, **how):
    table = spark.range(3).withColumn("v", F.lit(value))
    return write_audit_publish({"t": table, "u": table}, "t", str(tmp_path / "staging"), str(tmp_path / "final"), passing, plan_id=value, overwrite=True, **how)


def held(spark, tmp_path):
    """What is published, with its state; both or neither."""
    final = str(tmp_path / "final")
    state = read_state(spark, final)
    if state is None:
        return None
    assert state["state"] == "verified"
    values = {r["v"] for t in read_tables(spark, final, ["t", "u"]).values() for r in t.collect()}
    assert values == {state["plan_id"]}
    return state["plan_id"]


def at(step, error):
    def after(done):
        if done == step:
            raise error(step)

    return after


@pytest.mark.parametrize("before", [None, "old"])
@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("error", [ValueError, Crash])
def test_old_or_new_after_each_step(spark, tmp_path, step, before, error):
    if before:
        publish(spark, tmp_path, before)
    moved = STEPS.index(step) >= STEPS.index("moved")
    if error is ValueError and moved:
        publish(spark, tmp_path, "new", after=at(step, error))  # the new output was in its place, so it stays
    else:
        with pytest.raises((GateError, Crash)):
            publish(spark, tmp_path, "new", after=at(step, error))
    if error is Crash:
        recover(spark, str(tmp_path / "final"))
    assert held(spark, tmp_path) == ("new" if moved else before)
    assert recover(spark, str(tmp_path / "final")) is None
    publish(spark, tmp_path, "later")
    assert held(spark, tmp_path) == "later"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["final"]
