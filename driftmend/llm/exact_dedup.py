"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. Blocks are sorted and numbered, then
adjacent pairs of numbers are sorted and numbered, and so on, until each document is one number. Equal
numbers mean equal texts: no name rests on a hash.

Only documents all of whose blocks occur somewhere else can have a copy, so a first pass counts 64-bit
block hashes and sets the rest aside: a block seen once makes its document unique. A hash that stands
for several different blocks is told apart by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import global_rank, null_safe, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "text_sha256"]


def normalised(text: Column) -> Column:
    """Null as empty; A-Z, and no other letters, lower-cased."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _blocks(text: Column, chars: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def identities(docs: DataFrame, block_chars: int = 4096, hasher: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(all documents, those that may have a copy): KEY and copies; and of the latter (level, name).

    Equal texts, and only those, have equal (level, name). Rows that repeat a doc_id and its text are
    one row with their number in copies.
    """
    texts = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("t")).withColumn("text_sha256", F.sha2("t", 256)).withColumn("blocks", _blocks(F.col("t"), block_chars))
    light = texts.select(*KEY, F.transform("blocks", lambda b: hasher(b)).alias("hashes")).groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("hashes").alias("hashes"))
    light = written(light, "dedup-hashes")
    found = light.select(*KEY, F.posexplode("hashes").alias("pos", "h"))
    shared = written(light.select(F.explode("hashes").alias("h"), "copies").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "dedup-shared")
    met = found.join(shared, "h").groupBy(*KEY).agg(F.count("*").alias("met"))
    active = written(null_safe(light, met, KEY, "inner").filter(F.size("hashes") == F.col("met")).drop("met"), "dedup-active")

    there = null_safe(texts.select(*KEY, "blocks"), active.select(*KEY), KEY, "left_semi")
    contents = there.select(F.explode("blocks").alias("block")).select(hasher(F.col("block")).alias("h"), "block").distinct()
    # blocks are sorted by their beginning, a hash and the whole, so that the ranges' sample, which the driver sees, is small
    sortable = contents.withColumns({"begin": F.substring("block", 1, 24), "spread": F.xxhash64("block")})
    names = global_rank(sortable, ["begin", "spread", "block"], "name", "dedup-blocks", ranged=2).drop("begin", "spread")
    several = written(names.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "dedup-collided")
    occurs = active.select(*KEY, F.posexplode("hashes").alias("pos", "h"))
    if several.isEmpty():
        level = occurs.join(names.select("h", "name"), "h").select(*KEY, "pos", "name")
    else:
        plain = occurs.join(names.join(several, "h", "left_anti").select("h", "name"), "h").select(*KEY, "pos", "name")
        told = there.dropDuplicates(KEY).select(*KEY, F.posexplode("blocks").alias("pos", "block")).withColumn("h", hasher(F.col("block"))).join(several, "h", "left_semi")
        level = plain.unionByName(told.join(names.select("block", "name"), "block").select(*KEY, "pos", "name"))
    done, depth = None, 0
    while True:
        level = written(level, f"dedup-level{depth}")
        last = level.agg(F.max("pos")).first()[0]
        single = level.groupBy(*KEY).agg(F.max("pos").alias("top"), F.max("name").alias("name")).filter("top = 0") if last else level
        ended = single.select(*KEY, F.lit(depth).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if not last:
            break
        pairs = level.groupBy(*KEY, F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(0)).alias("b")
        )
        tops = pairs.groupBy(*KEY).agg(F.max("pos").alias("top"), F.max("b").alias("second")).filter("top > 0 or second > 0").select(*KEY)
        pairs = written(null_safe(pairs, tops, KEY, "left_semi"), f"dedup-pairs{depth}")
        named = global_rank(pairs.select("a", "b").distinct(), ["a", "b"], "name", f"dedup-names{depth}")
        level = pairs.join(named, ["a", "b"]).select(*KEY, "pos", "name")
        depth += 1
    return light.select(*KEY, "copies"), written(null_safe(done, active.select(*KEY, "copies"), KEY, "inner"), "dedup-identities")


def exact_dedup(docs: DataFrame, block_chars: int = 4096, hasher: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. Of a group the largest doc_id stays; a
    null doc_id counts as smallest. Rows that repeat both doc_id and text give a row each, count singly in
    group_size and stay or go together. Rows that repeat a doc_id with another text are documents of their
    own. An empty table gives no rows; other columns are ignored.
    """
    every, named = identities(docs, block_chars, hasher)
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).filter("group_size > 1")
    groups = written(groups, "dedup-groups")
    members = named.join(groups, ["level", "name"]).select(*KEY, "keep_id", "group_size")
    told = null_safe(every, members, KEY, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "copies").cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "copies",
    )
    told = written(told, "dedup-told")
    # a row that repeats many times is dealt to many tasks
    again = told.filter("copies > 1").withColumn("_part", F.explode(F.expr("sequence(0, (copies - 1) div 4096)"))).repartition(*KEY, "_part")
    again = again.withColumn("_copy", F.explode(F.expr("sequence(1, least(4096, copies - 4096 * _part))"))).drop("_part", "_copy")
    return told.filter("copies = 1").unionByName(again).drop("copies")
