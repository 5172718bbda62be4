"""Directory trees of hashes over manifests: equal subtrees are told by one hash, and a diff goes down only where hashes differ.

The files of all directories are hashed at once: those of a directory in buckets by the first 6 and then 3 hex digits of
the hash of their path, so that no task holds a directory of any size. Directories, which are far fewer, follow level by
level from the deepest to the root. A tree is stored as tables: directories by depth, buckets, and files by part.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmend.functions.columns import differs, tagged
from driftmend.operators.inventory import manifest_diff
from driftmend.sources.scratch import shared_folder, staged

DIGITS = (6, 3, 0)  # of the hash of a name: entries of a directory are hashed in buckets of equal first digits, step by step
PARTS = 64  # folders that the files of a tree are dealt to

_LEAVES = "path string, size long, hash string, depth int, dir string, bucket string, part int"
_BUCKETS = "depth int, dir string, bucket string, unhashed long, digest string"
_DIRS = "dir string, parent string, files long, bytes long, unhashed long, own_unhashed long, own string, digest string"


def _above(path: str) -> Column:
    """What comes before the last slash; nothing if there is none."""
    return F.expr(f"left({path}, length({path}) - length(substring_index({path}, '/', -1)) - 1)")


def _bucket(name: str) -> Column:
    return F.substring(F.sha1(F.col(name)), 1, DIGITS[0])


def _part() -> Column:
    """The folder of files that a bucket lies in, alike in all trees."""
    return F.pmod(F.xxhash64("depth", "dir", "bucket"), F.lit(PARTS)).cast("int")


def _rolled(rows: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """One row for each bucket of so many digits: the hash of the sorted digests in it, and sums."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("files", "bytes", "unhashed")]
    rows = rows.withColumn("bucket", F.substring("bucket", 1, digits))
    return rows.groupBy(*keys, "bucket").agg(*sums, F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"))


@dataclass(frozen=True)
class ManifestTree:
    """A tree as stored in a folder."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def leaves(self) -> DataFrame:
        return self._read("leaves", _LEAVES)

    @property
    def buckets(self) -> DataFrame:
        return self._read("buckets", _BUCKETS)

    @property
    def directories(self) -> DataFrame:
        """(dir, parent, files, bytes, unhashed, own_unhashed, own, digest, depth): the root is depth 0, its name empty."""
        return self._read("directories", _DIRS + ", depth int")

    def level(self, depth: int) -> DataFrame:
        return self.directories.filter(F.col("depth") == depth).drop("depth")

    def root(self) -> DataFrame:
        """One row: files, bytes and the digest of the whole tree."""
        return self.level(0).select("files", "bytes", "digest")


def _node(own: str, below: str) -> Column:
    return F.sha2(F.concat(F.lit("own="), F.coalesce(own, F.lit("-")), F.lit(";below="), F.coalesce(below, F.lit("-"))), 256)


def store_tree(manifest: DataFrame, folder: str | None = None) -> ManifestTree:
    """The tree of a manifest (path, size, hash), written to a new folder (of the shared scratch folder, if none is named).

    Paths aren't null. Names between slashes may be empty; repeated rows count each; an empty manifest has a root alone.
    A file without a hash is counted in `unhashed` of all directories above it, as its subtree can't be told equal.
    """
    spark = manifest.sparkSession
    folder = folder or f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    tree = ManifestTree(spark, folder)
    named = manifest.select("path", F.col("size").cast("long").alias("size"), "hash").withColumns({"depth": F.size(F.split("path", "/")) - 1, "dir": _above("path"), "bucket": _bucket("path")})
    named.withColumn("part", _part()).repartition("part", F.substring("bucket", 1, 1)).write.partitionBy("part").parquet(f"{folder}/leaves")

    entry = F.sha2(F.concat(tagged(F.col("path"), "string"), tagged(F.col("size"), "bigint"), tagged(F.col("hash"), "string")), 256)
    files = tree.leaves.select("depth", "dir", "bucket", F.lit(1).alias("files"), F.coalesce("size", F.lit(0)).alias("bytes"), F.col("hash").isNull().cast("int").alias("unhashed"), entry.alias("digest"))
    fine = staged({"fine": _rolled(files, ["depth", "dir"], DIGITS[0])}, "tree-buckets")["fine"]
    fine.select("depth", "dir", "bucket", "unhashed", "digest").write.parquet(f"{folder}/buckets")
    own = fine
    for digits in DIGITS[1:]:
        own = _rolled(own, ["depth", "dir"], digits)
    own = own.drop("bucket").withColumnsRenamed({"digest": "own", "unhashed": "own_unhashed"})
    up = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), 1, k), "/").alias("dir")))
    root = spark.range(1).select(F.lit(0).alias("depth"), F.lit("").alias("dir"))
    every = own.select(F.explode(up).alias("x")).select("x.depth", "x.dir").union(root).distinct()
    known = staged({"known": every.join(own, ["depth", "dir"], "left")}, "tree-directories")["known"]

    below = None
    for depth in range(known.agg(F.max("depth")).first()[0], -1, -1):  # as many steps as the deepest path has names
        here = known.filter(F.col("depth") == depth).drop("depth")
        if below is None:
            here = here.withColumns({"below": F.lit(None).cast("string"), "f": F.lit(0), "b": F.lit(0), "u": F.lit(0)})
        else:
            here = here.join(below.withColumnsRenamed({"files": "f", "bytes": "b", "unhashed": "u", "digest": "below"}), "dir", "left")
        sums = {"files": ("files", "f"), "bytes": ("bytes", "b"), "unhashed": ("own_unhashed", "u")}
        total = {c: (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).cast("long") for c, (x, y) in sums.items()}
        done = here.withColumns(total | {"digest": _node("own", "below"), "parent": _above("dir"), "own_unhashed": F.coalesce("own_unhashed", F.lit(0)).cast("long")})
        done.select("dir", "parent", "files", "bytes", "unhashed", "own_unhashed", "own", "digest").write.parquet(f"{folder}/directories/depth={depth}")
        item = F.sha2(F.concat(tagged(F.col("dir"), "string"), tagged(F.col("digest"), "string")), 256)
        below = spark.read.schema(_DIRS).parquet(f"{folder}/directories/depth={depth}").withColumns({"bucket": _bucket("dir"), "digest": item}).withColumn("dir", F.col("parent"))
        for digits in DIGITS:
            below = _rolled(below, ["dir"], digits)
        below = below.drop("bucket")
    return tree


def differing_directories(a: ManifestTree, b: ManifestTree) -> DataFrame:
    """(depth, dir) of the directories that differ, or may differ, in files of their own.

    From the root down, only what lies below directories that differ is looked at. Files without a hash make their directories differ.
    """
    wanted, touched, depth = None, a.spark.createDataFrame([], "depth int, dir string"), 0
    while True:
        side = lambda t, p: (t.level(depth) if wanted is None else t.level(depth).join(wanted, "parent", "left_semi")).select("dir", *[F.col(c).alias(f"{p}_{c}") for c in ("digest", "own", "unhashed", "own_unhashed")])
        both = side(a, "a").join(side(b, "b"), "dir", "full_outer")
        unsure = lambda c: (F.coalesce(f"a_{c}", F.lit(0)) + F.coalesce(f"b_{c}", F.lit(0))) > 0
        both = both.filter(differs(F.col("a_digest"), F.col("b_digest")) | unsure("unhashed"))
        found = staged({"level": both.select("dir", (differs(F.col("a_own"), F.col("b_own")) | unsure("own_unhashed")).alias("own"))}, f"tree-differs-{depth}")["level"]
        if found.isEmpty():
            return touched
        touched = touched.union(found.filter("own").select(F.lit(depth).alias("depth"), "dir"))
        wanted, depth = found.select(F.col("dir").alias("parent")), depth + 1


def tree_diff(a: ManifestTree, b: ManifestTree) -> DataFrame:
    """(path, change): what manifest_diff finds, reading the buckets of differing directories and the files of differing buckets alone."""
    touched = differing_directories(a, b)
    side = lambda t, p: t.buckets.join(touched, ["depth", "dir"], "left_semi").select("depth", "dir", "bucket", F.col("digest").alias(f"{p}_digest"), F.col("unhashed").alias(f"{p}_unhashed"))
    both = side(a, "a").join(side(b, "b"), ["depth", "dir", "bucket"], "full_outer")
    unsure = (F.coalesce("a_unhashed", F.lit(0)) + F.coalesce("b_unhashed", F.lit(0))) > 0
    both = both.filter(differs(F.col("a_digest"), F.col("b_digest")) | unsure).select("depth", "dir", "bucket")
    wanted = staged({"wanted": both.withColumn("part", _part())}, "tree-wanted")["wanted"]
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]  # no more than PARTS numbers
    files = lambda t: t.leaves.filter(F.col("part").isin(parts)).join(wanted.drop("part"), ["depth", "dir", "bucket"], "left_semi")
    return manifest_diff(files(a), files(b))
