"""Keeping identifiers out of what is published."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmend.functions.columns import BAR
from driftmend.llm.collocations import bloom
from driftmend.sources.scratch import staged

SHORTEST = 8


def sensitive_identifiers(tables: list[tuple[DataFrame, str]], shortest: int = SHORTEST) -> DataFrame:
    """(identifier): the distinct values of some columns that are long enough to be told from chance."""
    found = None
    for table, column in tables:
        one = table.select(F.col(column).cast("string").alias("identifier")).filter(F.length("identifier") >= shortest)
        found = one if found is None else found.union(one)
    return found.distinct()


def redaction(salt: str, identifier: Column) -> Column:
    """What stands for an identifier: redacted: and 12 hex digits."""
    return F.concat(F.lit("redacted:"), F.substring(F.sha2(F.concat(F.lit(salt + BAR), identifier), 256), 1, 12))


def _wide(text: Column) -> Column:
    """Four bytes a character, so that any stretch is found by its place."""
    return F.encode(text, "UTF-32")


def _cut(wide: Column, start: Column, stop: Column) -> Column:
    return F.substring(wide, (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int"))


def _grams(wide: Column, size: int) -> Column:
    """Hash of the stretch of so many characters at each place."""
    n = (F.octet_length(wide) / 4).cast("int")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(_cut(wide, i, i + size)))).otherwise(F.array().cast("array<bigint>"))


def _key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _passing(spark: SparkSession, keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """A function of an array of longs: place and value of those that may be among the n keys."""
    shared = spark.sparkContext.broadcast(bloom(keys, n))

    @F.arrow_udf("array<struct<at:int,gram:bigint>>")
    def passing(grams: pa.Array) -> pa.Array:
        values = grams.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(grams), 0).to_numpy(zero_copy_only=False))])
        found = np.flatnonzero(shared.value.has(values.view(np.uint64)))
        at = found - starts[np.searchsorted(starts, found, "right") - 1]
        each = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[found])], names=["at", "gram"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(found, starts).astype(np.int32)), each)

    return passing


def redacted(report: DataFrame, text: str, identifiers: DataFrame, salt: str, shortest: int = SHORTEST) -> DataFrame:
    """report with every occurrence of a known identifier in a text, inside longer words too, replaced by its redaction.

    Of overlapping identifiers the longest is replaced, of equally long ones the first. Null texts stay null, and each row
    keeps its other columns; the number of identifiers isn't bounded. All identifiers must have `shortest`
    characters or more.

    Each identifier is looked up by the stretch of `shortest` characters in it that the fewest identifiers share, so
    that a common beginning makes no candidates. Only hashes of stretches meet in that join, and of a text only those that pass a
    Bloom filter (64 MB at most) over the stretches looked up, so that what is shuffled grows with the hits; candidates are
    compared as a whole, once for each distinct text. What overlaps is settled in one sweep for each text, in
    time that grows with its length and the number of its hits.
    """
    known = identifiers.select("identifier", _wide(F.col("identifier")).alias("w")).filter(F.octet_length("w") >= 4 * shortest).distinct()
    grams = known.select("identifier", F.posexplode(_grams(F.col("w"), shortest)).alias("place", "gram"))
    rare = grams.join(grams.groupBy("gram").agg(F.countDistinct("identifier").alias("n")), "gram")
    anchors = rare.groupBy("identifier").agg(F.min(F.struct("n", "place", "gram")).alias("a")).select("identifier", "a.place", "a.gram")
    anchors = staged({"anchors": anchors}, "redaction-anchors")["anchors"]
    passing = _passing(report.sparkSession, anchors.select("gram"), anchors.count())
    texts = report.select(F.col(text).alias("t")).filter(F.length("t") >= shortest).distinct().withColumn("h", _key(F.col("t")))
    at = texts.select("h", F.explode(passing(_grams(_wide(F.col("t")), shortest))).alias("m")).select("h", "m.at", "m.gram")
    near = at.join(anchors, "gram").select("h", (F.col("at") - F.col("place")).alias("start"), "identifier").filter("start >= 0")
    near = near.groupBy("h").agg(F.collect_list(F.struct("start", "identifier")).alias("near"))
    stop = lambda m: m["start"] + F.char_length(m["identifier"])
    real = F.filter("near", lambda m: _cut(F.col("w"), m["start"], stop(m)) == _wide(m["identifier"]))
    hits = F.transform(real, lambda m: F.struct(m["start"].alias("start"), stop(m).cast("int").alias("stop"), m["identifier"].alias("identifier")))
    settled = F.arrow_udf(_settled, "array<struct<start:int,stop:int,identifier:string>>")
    found = texts.join(near, "h").withColumn("w", _wide(F.col("t"))).withColumn("kept", settled(hits)).filter(F.size("kept") > 0)
    found = found.withColumn("marks", F.transform("kept", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), redaction(salt, m["identifier"]).alias("mark"))))
    # before each mark what follows the one before it, and the end of the text
    ends = F.concat(F.array(F.lit(0)), F.transform("marks", lambda m: m["stop"]))
    pieces = F.transform("marks", lambda m, i: F.concat(F.decode(_cut(F.col("w"), F.get(ends, i), m["start"]), "UTF-32"), m["mark"]))
    tail = F.decode(_cut(F.col("w"), F.element_at(ends, -1), F.octet_length("w") / 4), "UTF-32")
    clean = found.select(F.col("h").alias("_h"), F.concat(F.array_join(pieces, ""), tail).alias("_clean"))
    whole = report.withColumn("_h", _key(F.col(text))).join(clean, "_h", "left")
    return whole.select(*[F.coalesce("_clean", text).alias(text) if c == text else F.col(c) for c in report.columns])


_KEPT = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("identifier", pa.string())]))


def _settled(hits: pa.Array) -> pa.Array:
    """Of the hits in each text those that are replaced, in their order: the longest first, of equally long ones the first.

    A hit overlaps with one that was taken before, and so isn't shorter, only if that covers its first or last character.
    """
    out = []
    for row in hits:
        found = row.values
        start, stop = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
        names = found.field("identifier").to_pylist()
        order = sorted(range(len(start)), key=lambda i: (start[i] - stop[i], start[i], names[i]))
        covered, kept = np.zeros(int(stop.max(initial=0)), bool), []
        for i in order:
            a, b = int(start[i]), int(stop[i])
            if not (covered[a] or covered[b - 1]):
                covered[a:b] = True
                kept.append(i)
        out.append([{"start": int(start[i]), "stop": int(stop[i]), "identifier": names[i]} for i in sorted(kept, key=lambda i: start[i])])
    return pa.array(out, _KEPT)


SHARD = 200_000  # identifiers that one automaton holds, about


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        found.add_word(w)
    found.make_automaton()
    return found


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _leaky(texts: DataFrame, words: list[str]) -> DataFrame:
    """The texts (t, n) that contain one of the words, each read once whatever the number and lengths of the words."""
    if not words:
        return texts.limit(0)
    shared, name = texts.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def leaks(column: pa.Array) -> pa.Array:
        if name not in _BUILT:
            _BUILT.clear()  # a worker keeps one automaton
            _BUILT[name] = _automaton(shared.value)
        known = _BUILT[name]
        return pa.array([next(known.iter(t), None) is not None if t else False for t in column.to_pylist()], pa.bool_())

    return texts.filter(leaks.asNondeterministic()(F.col("t")))


def privacy_scan(report: DataFrame, text: str, identifiers: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row: texts that contain a known identifier anywhere (leaks) and the texts scanned, null ones among them.

    Identifiers are dealt by hash into shards of bounded size, of which the driver holds one at a time; each is an Aho-Corasick automaton
    that all distinct texts stream through. Nothing is shared with redacted. Null and empty identifiers are none.
    """
    known = identifiers.select(F.col("identifier").cast("string").alias("identifier")).filter("identifier <> ''").distinct()
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    texts = report.groupBy(F.col(text).cast("string").alias("t")).agg(F.count("*").alias("n"))
    shards = max(1, -(-known.count() // shard))
    found = None
    for k in range(shards):
        own = known if shards == 1 else known.filter(F.pmod(F.xxhash64("identifier"), F.lit(shards)) == k)
        leaky = _leaky(texts, [r[0] for r in own.toLocalIterator()]).select(F.sha2("t", 256).alias("h"), "n")
        found = leaky if found is None else found.union(leaky)
    found = found if shards == 1 else found.dropDuplicates(["h"])
    return found.agg(n("n").alias("leaks")).join(texts.agg(n("n").alias("scanned")))  # two tables of one row each
