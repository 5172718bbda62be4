"""Intermediate tables in a folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of its own if Spark runs in one local process, and else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="driftmend-"))
    return _OWN[0]


def staged(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The tables as written to a new folder and read back, so that what follows reads files and computes nothing again."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    found = {}
    for k, table in tables.items():
        table.write.parquet(f"{folder}/{k}")
        found[k] = spark.read.schema(table.schema).parquet(f"{folder}/{k}")
    return found
