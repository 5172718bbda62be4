"""Pairs of snapshots of one keyed database."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SnapshotPair:
    """The tables of two snapshots by logical name; both sides are only read."""

    old: dict[str, DataFrame]
    current: dict[str, DataFrame]


def read_tables(spark: SparkSession, folder: str, tables: list[str], form: str = "parquet", suffix: str = "") -> dict[str, DataFrame]:
    """Tables by name from a folder with a file or folder for each, in any format that Spark reads."""
    return {t: spark.read.format(form).load(f"{folder}/{t}{suffix}") for t in tables}


def read_pair(spark: SparkSession, old: str, current: str, tables: list[str], form: str = "parquet", suffix: str = "") -> SnapshotPair:
    """A pair from two folders."""
    return SnapshotPair(read_tables(spark, old, tables, form, suffix), read_tables(spark, current, tables, form, suffix))


def store_bucketed(tables: dict[str, DataFrame], name: str, keys: dict[str, str], buckets: int, folder: str) -> dict[str, DataFrame]:
    """Store tables as name_table in a folder, those with a key dealt into buckets by it, each sorted; the tables as read from there.

    Two snapshots with equal numbers of buckets are reduced, compared and repaired where their rows lie: nothing that goes by the
    key is shuffled. A key that many rows share, and the missing one, makes its bucket large, but is read by one task in order
    and summed up at once. The tables are registered in the session's catalog, where `name_table` must be free.
    """
    spark = next(iter(tables.values())).sparkSession
    for table, rows in tables.items():
        out = rows.write.format("parquet").option("path", f"{folder}/{name}_{table}")
        if table in keys:
            # one file for each bucket: rows go to the task of their bucket before they are written
            out = rows.repartition(buckets, keys[table]).write.format("parquet").option("path", f"{folder}/{name}_{table}").bucketBy(buckets, keys[table]).sortBy(keys[table])
        out.saveAsTable(f"{name}_{table}")
    return {table: spark.table(f"{name}_{table}") for table in tables}
