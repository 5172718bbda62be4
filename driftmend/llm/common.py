"""Shared helpers: tables in the cluster's shared folder, distributed ranks and running totals."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share.

    Where that is unset, one of its own if Spark runs in one local process, as in tests; on a cluster that's an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="driftmend-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage with files that every executor sees, so a lost executor costs only its
    running tasks. The files stay as long as results that read them may be asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict[tuple, object] = {}


def held(make: Callable, *key):
    """What a Python worker keeps from task to task: make(*key), for one key at a time.

    Workers outlive stages, so a worker that goes on to another operator lets go of what the last one kept.
    """
    if (make, *key) not in _HELD:
        _HELD.clear()
        _HELD[make, *key] = make(*key)
    return _HELD[make, *key]


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which turns batches into batches in a Python worker, with unused memory given back after each of them."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return lean


def _offsets(table: DataFrame, sizes: Column) -> DataFrame:
    """One row per partition number _p (never more than shuffle partitions) with what precedes it."""
    spark = table.sparkSession
    rows, total = [], 0
    for r in sorted(table.groupBy("_p").agg(sizes.alias("n")).collect(), key=lambda r: r["_p"]):
        rows.append((r["_p"], total))
        total += r["n"]
    return F.broadcast(spark.createDataFrame(rows, "_p int, _before long"))


def range_sorted(df: DataFrame, cols: list[str], ranged: int | None = None) -> DataFrame:
    """df in range partitions, each sorted, with the partition number _p and the row number in it, _i.

    Ranges are told by the first `ranged` of the columns, of which the driver sees a sample.
    """
    return (
        df.repartitionByRange(*cols[:ranged])
        .sortWithinPartitions(*cols)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )


def global_rank(df: DataFrame, cols: list[str], rank: str, name: str, ranged: int | None = None) -> DataFrame:
    """Number the rows of df 1, 2, ... in the order of cols (distinct rows), with no single-task sort."""
    table = written(range_sorted(df, cols, ranged), name)
    return table.join(_offsets(table, F.count("*")), "_p").withColumn(rank, F.col("_i") + F.col("_before") + 1).drop("_p", "_i", "_before")


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys with nulls equal; of the key columns, those of a stay."""
    renamed = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        c = a[k].eqNullSafe(renamed[f"_r_{k}"])
        on = c if on is None else on & c
    return a.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def held_out(doc_id: Column) -> Column:
    """Is a document kept from all learning? crc32 of its id as text (null: empty) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2
