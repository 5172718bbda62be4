"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated a bounded number of times (epochs). The mix is as long as
all sources together; weights share it, sources that reach their bound are clamped there, and what is left
is shared again by weight until no source is above its bound. A source's target is then drawn as whole
repetitions of all its documents plus one fractional repetition: its documents in a seeded random order
as far as the target reaches, the last one in part.

Running totals within a source use buckets of the seeded order, about as many as the square root of the
number of rows, so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmend.llm.common import global_rank, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeating_weights(rank: Column) -> Column:
    """5, 2, 1, 5, 2, ... by rank from 1."""
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")


def targets(sources: DataFrame, epochs: int = 3, weight: Callable[[Column], Column] = repeating_weights) -> DataFrame:
    """sources (src, missing, source_size) with weight, and target: the capped water-filling.

    weight is given the rank of a source, by code point with null last. Each round clamps every source
    above its bound; only three sums reach the driver in a round. A source of size 0 gets 0.
    """
    at = global_rank(sources, ["missing", "src"], "rank", "mix-sources")
    at = written(at.select("src", "missing", "source_size", weight(F.col("rank")).alias("weight")), "mix-weights")
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")]
    every = at.agg(*sums).first()
    left, share, n = every["s"], every["w"], 0
    while True:
        # the level left / share only rises from round to round, so a clamped source stays clamped
        over = F.lit(float(epochs)) * F.col("source_size") * F.lit(float(share)) <= F.lit(float(left)) * F.col("weight")
        clamped = at.filter(over).agg(*sums).first()
        if clamped["n"] in (n, every["n"]):
            break
        n, left, share = clamped["n"], every["s"] - epochs * clamped["s"], every["w"] - clamped["w"]
    return at.withColumn("target", F.when(over, F.lit(float(epochs)) * F.col("source_size")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(max(share, 1)))))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Of each row: its source, size and place in the seeded order."""
    key = F.struct(
        # the text's hash keeps rows without a doc_id, or with one that repeats, from meeting in one place
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("h"),
        F.col("doc_id"),
        words(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"),
    )
    return docs.withColumns({"src": F.coalesce("source", F.lit("")), "missing": F.col("source").isNull(), "place": key})


def plan(docs: DataFrame, epochs: int = 3, weight: Callable[[Column], Column] = repeating_weights, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows without their texts, sources): a source has its target, whole repetitions, and where the fractional one ends."""
    light = written(_sized(docs, seed).select("doc_id", "src", "missing", "place"), "mix-sizes")
    buckets = max(1, math.isqrt(light.count()))
    light = light.withColumn("bucket", F.floor(F.conv(F.substring("place.h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"))
    sums = written(light.groupBy("src", "missing", "bucket").agg(F.sum("place.size").alias("words")), "mix-buckets")
    sources = targets(sums.groupBy("src", "missing").agg(F.sum("words").alias("source_size")), epochs, weight)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest("source_size", F.lit(1))
    sources = written(sources.withColumn("whole", F.floor(budget / size).cast("long")).withColumn("rest", budget - F.col("whole") * size), "mix-targets")

    upto = Window.partitionBy("src", "missing").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .join(sources, ["src", "missing"])
        .filter("before < rest and before + words >= rest")
        .select("src", "missing", "bucket", (F.col("rest") - F.col("before")).alias("here"))
    )
    inside = Window.partitionBy("src", "missing").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        light.join(last, ["src", "missing", "bucket"])
        .groupBy("src", "missing", "place", "here")
        .agg(F.sum("place.size").alias("words"), F.count("*").alias("alike"))
        .withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .filter("before < here and before + words >= here")
        .select("src", "missing", F.col("place").alias("end"), F.floor((F.col("here") - F.col("before")) / F.col("alike")).cast("long").alias("part"))
    )
    return light, written(sources.join(ends, ["src", "missing"], "left"), "mix-plan")


def _taken() -> Column:
    size, place, end = F.col("place.size"), F.col("place"), F.col("end")
    more = F.when(end.isNull() | (place > end), F.lit(0)).when(place == end, F.col("part")).otherwise(size)
    return (F.col("whole") * size + more).cast("long")


def mix_plan(docs: DataFrame, epochs: int = 3, weight: Callable[[Column], Column] = repeating_weights, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null text has size 0. Null sources are one source, the last. Documents of one source differ only by
    the seeded order; rows that repeat each other entirely share a partial repetition evenly. An empty
    table gives no rows; other columns are ignored.
    """
    light, sources = plan(docs, epochs, weight, seed)
    return light.join(sources, ["src", "missing"]).select(
        "doc_id", F.when(~F.col("missing"), F.col("src")).alias("source"), F.col("place.size").alias("size"), "source_size", "target", _taken().alias("taken")
    )


def mixed(docs: DataFrame, epochs: int = 3, weight: Callable[[Column], Column] = repeating_weights, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, with their columns, as often as they are taken.

    A partial repetition has the first words of its text, and n_chars, if there, is that of what is left.
    Documents without words take no room and are left out.
    """
    _, sources = plan(docs, epochs, weight, seed)
    names = docs.columns
    rows = _sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source"), seed).select("row", "src", "missing", "place")
    rows = rows.join(sources, ["src", "missing"]).withColumn("taken", _taken())
    size, part = F.col("place.size"), F.expr("taken % place.size")
    copies = F.expr("cast(taken div place.size as int)")
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    rows = rows.filter(size > 0).withColumn("words", F.explode(pieces))
    tokens = F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("words"), F.lit(0)).cast("int"))
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(F.array_join(tokens, " "))
    rows = rows.withColumn("cut", text)
    new = {"text": F.col("cut")} | ({"n_chars": F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length("cut")).cast("long")} if "n_chars" in names else {})
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
