"""Directories as tables of files, read in ranges.

Spark lists the files; what is read of them is a table of ranges (path, offset, length), dealt over the tasks, so that a file
of any size is read by many tasks at once and none holds more than a chunk of it. Ranges are opened through Arrow's file
systems (local, HDFS, S3 and others by the path's scheme) or through a function of one's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 8 << 20  # bytes that are hashed as one
FAN = 4096  # hashes that are hashed as one
CHUNK = 1 << 20  # bytes that a task holds
TASK = 256 << 20  # bytes that a task reads, about

Opener = Callable[[str], BinaryIO]


def open_file(path: str) -> BinaryIO:
    """A seekable file by its path or URI, through Arrow's file systems."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "/", path)
    system, place = (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all files below a path; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))


def ranges(found: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, offset, length): files (path, size) in pieces; an empty file has one of length 0."""
    last = F.greatest(F.col("size") - 1, F.lit(0))
    # a range of ranges first, so that no row holds the offsets of a whole large file
    far = found.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / (piece * FAN)).cast("long"))).alias("g"))
    first, end = F.col("g") * FAN, F.least((F.col("g") + 1) * FAN - 1, F.floor(last / piece).cast("long"))
    near = far.select("path", "size", F.explode(F.sequence(first, end)).alias("i"))
    return near.select("path", (F.col("i") * piece).alias("offset"), F.least(F.lit(piece), F.col("size") - F.col("i") * piece).cast("long").alias("length"))


def read_ranges(wanted: DataFrame, opener: Opener = open_file, hashed: bool = True) -> DataFrame:
    """(path, offset, content, problem) of ranges (path, offset, length): the SHA-256 of each range in hex, or its bytes.

    A range that can't be read, or ends before its length, has no content and says why.
    """

    def read(path: str, offset: int, length: int, held: list) -> str | bytes:
        if not held or held[0] != path:
            if held:
                held[1].close()
            held[:] = [path, opener(path)]
        file, left, digest, parts = held[1], length, hashlib.sha256(), []
        file.seek(offset)
        while left:
            chunk = file.read(min(left, CHUNK))
            if not chunk:
                raise OSError(f"ends {left} bytes early")
            left -= len(chunk)
            digest.update(chunk) if hashed else parts.append(chunk)
        return digest.hexdigest() if hashed else b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            found, problems = [], []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                try:
                    found.append(read(path, offset, length, held))
                    problems.append(None)
                except (OSError, pa.ArrowException) as e:
                    held.clear()
                    found.append(None)
                    problems.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("offset"), pa.array(found, pa.string() if hashed else pa.binary()), pa.array(problems, pa.string())], names=["path", "offset", "content", "problem"])
        if held:
            held[1].close()

    return wanted.mapInArrow(run, f"path string, offset long, content {'string' if hashed else 'binary'}, problem string")


def _dealt(wanted: DataFrame, total: int) -> DataFrame:
    return wanted.repartition(max(1, min(-(-total // TASK), 1 << 15)), "path", "offset") if total > TASK else wanted


def _joined(group: Column) -> Column:
    """One hash for a group of (offset, content), in their order; that of a single one is its own."""
    listed = F.array_sort(group)
    return F.when(F.size(listed) == 1, listed[0]["content"]).otherwise(F.sha2(F.concat(F.lit("tree:"), F.array_join(F.transform(listed, lambda x: x["content"]), "")), 256))


def tree_hash(pieces: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """(path, hash, problem) from (path, offset, content, problem) of all pieces of files.

    Up to `fan` hashes in order are hashed as one, level by level up to one root. A file of one piece has its SHA-256. A file of which
    a piece couldn't be read has no hash, and the first problem.
    """
    level, span = pieces, piece
    for _ in range(4):  # enough for 8 MiB * 4096 ** 3 and any file in one more
        span = min(span * fan, 1 << 62)
        parts = F.collect_list(F.struct("offset", "content"))
        bad = F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("offset")))
        level = level.groupBy("path", (F.floor(F.col("offset") / span) * span).cast("long").alias("offset")).agg(F.when(F.count("content") == F.count("*"), _joined(parts)).alias("content"), bad.alias("problem"))
    return level.select("path", F.col("content").alias("hash"), "problem")


def dir_manifest(spark: SparkSession, path: str, opener: Opener = open_file, piece: int = PIECE) -> DataFrame:
    """(path, size, hash, problem) of all files below a path, of any size: the tree hash of their pieces, read in ranges."""
    found = files(spark, path)
    total = found.agg(F.sum("size")).first()[0] or 0
    hashes = tree_hash(read_ranges(_dealt(ranges(found, piece), total), opener), piece)
    return found.join(hashes, "path").select("path", "size", "hash", "problem")


def header_check(spark: SparkSession, path: str, magic: bytes, opener: Opener = open_file) -> DataFrame:
    """(path, ok): does each file begin with the magic bytes? No more than these are read; null if a file can't be read."""
    found = files(spark, path)
    wanted = found.filter(F.col("size") >= len(magic)).select("path", F.lit(0).cast("long").alias("offset"), F.lit(len(magic)).cast("long").alias("length"))
    heads = read_ranges(wanted.repartition("path"), opener, hashed=False).select("path", (F.col("content") == F.lit(bytearray(magic))).alias("ok"))
    return heads.union(found.filter(F.col("size") < len(magic)).select("path", F.lit(not magic)))
