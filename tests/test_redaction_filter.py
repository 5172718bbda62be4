"""Of a text only the stretches that may be looked up leave its row."""

from pyspark.sql import functions as F

from driftmend.functions.privacy import _passing


def test_only_stretches_that_may_be_known_pass(spark):
    lists = [(0, list(range(1000))), (1, []), (2, None), (3, [7, 5_000_000_000, 7]), (4, [-1, -2])]
    table = spark.createDataFrame(lists, "k int, g array<bigint>").coalesce(1)
    keys = spark.createDataFrame([(7,), (500,), (-2,)], "gram bigint")
    found = table.select("k", F.explode(_passing(spark, keys, 3)(F.col("g"))).alias("m")).select("k", "m.at", "m.gram").collect()
    assert {tuple(r) for r in found} >= {(0, 7, 7), (0, 500, 500), (3, 0, 7), (3, 2, 7), (4, 1, -2)} and len(found) < 10
    assert all(dict(lists)[k][at] == gram for k, at, gram in found)
