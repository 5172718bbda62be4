"""Order-free digests of whole tables.

A row is hashed over type-tagged, length-prefixed values; equal rows are counted; the distinct hashes are dealt by their
own first digits into buckets of bounded size, whose sorted contents are hashed, and the bucket hashes again, up to one
root. No task ever holds more than a bucket, whatever the keys or the number of equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmend.functions.columns import tagged

BUCKET = 4096


def row_hashes(table: DataFrame, columns: list[str]) -> DataFrame:
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return table.select(F.sha2(F.concat(*[tagged(quoted(c), table.schema[c].dataType) for c in columns]), 256).alias("h"))


def table_digest(table: DataFrame, columns: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row: rows and digest of a table as a multiset of rows; two tables are equal if and only if their digests are."""
    counted = row_hashes(table, columns or table.columns).groupBy("h").agg(F.count("*").alias("n"))
    size = F.broadcast(counted.agg(F.greatest(F.ceil(F.count("*") / bucket), F.lit(1)).alias("buckets")))
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    low = counted.join(size).withColumn("b", F.pmod(place, F.col("buckets")))
    low = low.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", "n"))), ","), 256).alias("d"), F.sum("n").alias("n"))
    high = low.groupBy(F.floor(F.col("b") / bucket).alias("s")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("d"), F.sum("n").alias("n"))
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "d"))), lambda x: x["d"]), ","), 256)
    return high.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), root.alias("digest"))


def table_differences(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows_gone, rows_new, same_columns) of the tables of either side, compared as multisets of rows.

    All tables are compared in one shuffle of row hashes, with equal rows counted before it. A table that a side lacks
    has no rows there and other columns.
    """
    names = sorted({*before, *after})
    spark = next(iter([*before.values(), *after.values()])).sparkSession
    columns = lambda t: sorted((f.name, f.dataType.simpleString()) for f in t.schema) if t is not None else None
    rows = None
    for tables, sign in ((before, -1), (after, 1)):
        for name in sorted(tables):
            one = row_hashes(tables[name], sorted(tables[name].columns)).select(F.lit(name).alias("table_name"), "h", F.lit(sign).alias("sign"))
            rows = one if rows is None else rows.union(one)
    moved = rows.groupBy("table_name", "h").agg(F.sum("sign").alias("d")).filter("d <> 0").groupBy("table_name")
    moved = moved.agg(F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("rows_gone"), F.sum(F.greatest(F.col("d"), F.lit(0))).alias("rows_new"))
    known = spark.createDataFrame([(n, columns(before.get(n)) == columns(after.get(n))) for n in names], "table_name string, same_columns boolean")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.join(moved, "table_name", "left").select("table_name", n("rows_gone"), n("rows_new"), "same_columns")


def changed_tables(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table_name, changed) of the tables of either side; one that a side lacks has changed."""
    return table_differences(before, after).select("table_name", ((F.col("rows_gone") + F.col("rows_new") > 0) | ~F.col("same_columns")).alias("changed"))
