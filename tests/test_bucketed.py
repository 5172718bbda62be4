"""Snapshots that are stored in buckets of their identities are classified and repaired where they lie."""

import re
import uuid

from driftmend.operators.classify import analysis_counts, classify
from driftmend.operators.repair import repair
from driftmend.plans.rules import MESSAGE_RULE as RULE
from driftmend.queries import _pair
from driftmend.sources.snapshots import SnapshotPair, store_bucketed


def shuffles(df):
    """Exchanges of the plan other than broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)(?<!Reused)Exchange \w+", plan.replace("BroadcastExchange", "Broadcast"))


def test_no_shuffle_on_buckets(spark, sf, tmp_path):
    pair, name = _pair(spark, sf), f"t{uuid.uuid4().hex[:8]}"
    side = lambda which: store_bucketed(getattr(pair, which), f"{name}_{which}", {RULE.table: RULE.identity}, 4, str(tmp_path))
    stored = SnapshotPair(side("old"), side("current"))
    try:
        assert shuffles(classify(stored, RULE)) == [] and shuffles(classify(pair, RULE)) != []
        assert shuffles(repair(stored, RULE)) == []
        same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        assert analysis_counts(classify(stored, RULE), RULE).collect() == analysis_counts(classify(pair, RULE), RULE).collect()
        assert same(repair(stored, RULE).select(sorted(pair.current[RULE.table].columns)), repair(pair, RULE).select(sorted(pair.current[RULE.table].columns)))
    finally:
        for which in ("old", "current"):
            for table in ("message", "chat", "user"):
                spark.sql(f"DROP TABLE IF EXISTS {name}_{which}_{table}")
