"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band. Of each document the distinct
lexicon terms are sorted and hashed: all of them, and those of 8 random subsets of the lexicon at each of
6 rates (a quarter of the terms, a sixteenth, ...). A change of few terms leaves the hashes of many
sparse subsets as they were; how many stay tells how alike two documents are.

The band is a share of documents, so the lexicon has at most (mean distinct terms a document) / low
terms at any size of the corpus. It is broadcast up to BROADCAST terms; a larger one is joined with the terms of
the distinct texts instead, to the same fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftmend.llm.common import frugal, written
from driftmend.llm.words import mix, slices, word_hashes

LOW, HIGH = 0.0005, 0.05
SEEDS, LEVELS, STEP = 8, 6, 2  # subsets a level; levels; each level keeps 1 in 2**STEP terms of the one before
WIDTH = 1 + SEEDS * LEVELS
FEW = 4  # a level tells something if so many of its subsets aren't empty
BROADCAST = 4_000_000  # terms of a lexicon that is broadcast, at 8 bytes each


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of the distinct terms of each text, sorted."""
    hashes, starts = word_hashes(pc.utf8_lower(texts))
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have each term, summed up over as many texts as a worker can well hold."""
    terms, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        for part in slices(batch):
            both = np.concatenate([terms, _distinct(part.column("text"))[1]])
            weight = np.concatenate([n, np.ones(len(both) - len(terms), np.int64)])
            terms, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, weight, len(terms)).astype(np.int64)
            if len(terms) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])
                terms, n = terms[:0], n[:0]
    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): hashes of the terms that at least low and at most high of all documents have. Their frequencies are exact."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(_count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = docs.count()
    return written(counts.filter((F.col("n") >= low * total) & (F.col("n") <= max(high * total, 1)) & (F.col("n") > 0)).select("term"), "lexicon")


def _sorted_terms(table: DataFrame) -> np.ndarray:
    return np.sort(np.concatenate([np.empty(0, np.int64), table.toPandas()["term"].to_numpy(np.int64)]).view(np.uint64))


def prints(of: np.ndarray, hashes: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    """One row of WIDTH 16-bit hashes for each of n texts, from its distinct terms; 0 stands for a subset of which the text has no term.

    known: which terms are in the lexicon. A text without any of them is hashed by all its terms, one without terms has
    only zeros.
    """
    known = known | (np.bincount(of[known], minlength=n)[of] == 0)
    of, hashes = of[known], hashes[known]
    out = np.zeros((n, WIDTH), np.uint16)

    def put(column: int, of: np.ndarray, values: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
        if len(first):
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(values, first)
            out[of[first], column] = np.maximum(mix(sums) >> np.uint64(48), np.uint64(1)).astype(np.uint16)

    put(0, of, mix(hashes, 1))
    for seed in range(SEEDS):
        o, v = of, mix(hashes, 2 + seed)
        for level in range(LEVELS):
            keep = (v >> np.uint64(STEP * level)) & np.uint64((1 << STEP) - 1) == 0
            o, v = o[keep], v[keep]
            put(1 + level * SEEDS + seed, o, v * np.uint64(0x9E3779B97F4A7C15))
    return out


def fingerprints(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """prints of texts by a sorted lexicon."""
    of, hashes = _distinct(texts)
    at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
    return prints(of, hashes, terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool), len(texts))


def _joined_prints(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, fingerprint) of the distinct texts (text), h their SHA-256, with a lexicon of any size."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                of, hashes = _distinct(part.column("text"))
                ends = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], names=["h", "terms"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            found = prints(of, flat.field("term").to_numpy().view(np.uint64), flat.field("known").to_numpy(zero_copy_only=False), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(as_hex(found), pa.string())], names=["h", "fingerprint"])

    each = texts.select("text", F.sha2("text", 256).alias("h")).dropDuplicates(["h"]).mapInArrow(frugal(listed), "h string, terms array<long>")
    each = each.select("h", F.explode_outer("terms").alias("term")).join(terms.withColumn("known", F.lit(True)), "term", "left")
    one = F.when(F.col("term").isNotNull(), F.struct("term", F.coalesce("known", F.lit(False)).alias("known")))
    return each.groupBy("h").agg(F.array_sort(F.collect_list(one)).alias("terms")).mapInArrow(frugal(told), "h string, fingerprint string")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: the share of equal subsets in the sparsest level with enough that aren't empty."""
    there, same = (a != 0) | (b != 0), (a == b) & (a != 0)
    result = (a[:, 0] == b[:, 0]).astype(float)
    for level in range(LEVELS):
        at = slice(1 + level * SEEDS, 1 + (level + 1) * SEEDS)
        n = there[:, at].sum(1)
        result = np.where(n >= FEW, same[:, at].sum(1) / np.maximum(n, 1), result)
    return result


def from_hex(texts: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(texts)), ">u2").reshape(-1, WIDTH).astype(np.uint16)


def as_hex(rows: np.ndarray) -> list[str]:
    text, w = rows.astype(">u2").tobytes().hex(), 4 * WIDTH
    return [text[i * w : (i + 1) * w] for i in range(len(rows))]


def fingerprint(docs: DataFrame, low: float = LOW, high: float = HIGH, broadcast: int = BROADCAST) -> DataFrame:
    """docs with a column fingerprint (hex), which replaces one of that name. Null text counts as empty."""
    found = lexicon(docs, low, high)
    names = [c for c in docs.columns if c != "fingerprint"]
    if found.count() > broadcast:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        told = _joined_prints(docs.select(text.alias("text")), found).withColumnRenamed("fingerprint", "_print").withColumnRenamed("h", "_h")
        return docs.select(*names, F.sha2(text, 256).alias("_h")).join(told, "_h", "left").select(*names, F.col("_print").alias("fingerprint"))
    terms = docs.sparkSession.sparkContext.broadcast(_sorted_terms(found))

    @F.arrow_udf("string")
    def add(texts: pa.Array) -> pa.Array:
        parts = [as_hex(fingerprints(p.column("text"), terms.value)) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        return pa.array([x for part in parts for x in part], pa.string())

    return docs.select(*names, add(F.col("text").cast("string")).alias("fingerprint"))


def _edited(text: str, following: str) -> str:
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: pa.Array, texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray, terms: np.ndarray) -> list[pa.Array]:
    """The columns of edit_likeness for some documents and those that come after them."""
    edited = [_edited(t, a) for t, a in zip(texts, after)]
    changed = fingerprints(pa.array(edited, pa.string()), terms)
    sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    numbers = pa.array([len(t) for t in texts], pa.int64())
    return [ids, numbers, pa.array(sha, pa.string()), pa.array(as_hex(own), pa.string()), pa.array(as_hex(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, following))]


def _neighbours(docs: DataFrame, terms, name: str) -> tuple[DataFrame, DataFrame]:
    """(documents with the one after them, compared; documents at the end of a range with the one that the next range begins with).

    Rows are sorted by range by doc_id, then hash of the text, so that rows of one id are spread as well. Whatever has its
    successor in its range is done there (terms: the lexicon; without one only texts are paired). The first and the last
    row of each range are kept with their texts, and the ends meet afterwards: (doc_id, text, after).
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = slim.repartitionByRange("doc_id", "h", F.rand(3)).sortWithinPartitions("doc_id", "h", "text").drop("h")
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))] if terms else ["doc_id"]
    extra = ["place", "p", "text", "after"]
    doc_type = to_arrow_type(slim.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, held_prints = TaskContext.get().partitionId(), None, None

        def border(place: str, part: pa.RecordBatch) -> pa.RecordBatch:
            blank = [pa.nulls(1, t) for t in kinds[1 : len(names)]]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *blank, pa.array([place]), pa.array([p]), part.column("text"), pa.nulls(1, pa.string())], names=[*names, *extra])

        kinds = [doc_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        for batch in batches:
            for part in slices(batch):
                if held is None:
                    yield border("first", part.slice(0, 1))
                seen = pa.Table.from_batches(([held] if held else []) + [part]).combine_chunks().to_batches()[0]
                texts, m = seen.column("text").to_pylist(), seen.num_rows - 1
                if terms:
                    new = fingerprints(part.column("text"), terms.value)
                    found = new if held is None else np.concatenate([held_prints, new])
                    held_prints = found[-1:]
                if m:
                    ids, none = seen.column("doc_id").slice(0, m), pa.nulls(m, pa.string())
                    own = _compared(ids, texts[:-1], texts[1:], found[:-1], found[1:], terms.value) if terms else [ids]
                    kept = [none, none] if terms else [seen.column("text").slice(0, m), seen.column("text").slice(1, m)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(["inner"] * m), pa.array([p] * m), *kept], names=[*names, *extra])
                held = seen.slice(m, 1)
        if held is not None:
            yield border("last", held)

    schema = f"doc_id {kind}, " + (RESULT + ", " if terms else "") + "place string, p long, text string, after string"
    table = written(rows.mapInArrow(frugal(run), schema), name)
    ends = table.filter("place <> 'inner'")
    ps = sorted(r["p"] for r in ends.filter("place = 'last'").select("p").collect())  # a number for each range
    follows = spark.createDataFrame(list(zip(ps, ps[1:] + ps[:1])), "p long, next long")
    first = ends.filter("place = 'first'").select(F.col("p").alias("next"), F.col("text").alias("after"))
    met = ends.filter("place = 'last'").drop("after").join(F.broadcast(follows), "p").join(first, "next")
    return table.filter("place = 'inner'"), met.select("doc_id", "text", "after")


def edit_likeness(docs: DataFrame, low: float = LOW, high: float = HIGH, broadcast: int = BROADCAST) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The edited text has the last quarter (floor of code points / 4) replaced by as many first code points of
    the next document by doc_id (all, if it has fewer); after the last comes the first. doc_id may be of any type
    that can be sorted; null comes first. Rows that repeat a doc_id follow each other by a hash of their text. Null
    text counts as empty; an empty table gives no rows; other columns are ignored. Equal texts have equal
    fingerprints, and likeness 1.
    """
    found = lexicon(docs, low, high)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
    if found.count() <= broadcast:
        terms = docs.sparkSession.sparkContext.broadcast(_sorted_terms(found))
        inner, ends = _neighbours(docs, terms, "fingerprint-rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, after = (fingerprints(batch.column(c), terms.value) for c in ("text", "after"))
                yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("after").to_pylist(), own, after, terms.value), names=names)

        return inner.select(*names).unionByName(ends.mapInArrow(run, f"doc_id {kind}, {RESULT}"))

    inner, ends = _neighbours(docs, None, "fingerprint-pairs")
    pairs = inner.select("doc_id", "text", "after").unionByName(ends)
    part = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - part), F.substring("after", F.lit(1), part))
    pairs = written(pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("h"), F.sha2("after", 256).alias("after_h"), F.sha2(edited, 256).alias("edited_sha256"), "text", edited.alias("edited")), "fingerprint-edits")
    told = written(_joined_prints(pairs.select("text").union(pairs.select("edited")), found), "fingerprint-told")
    of = lambda h, name: told.select(F.col("h").alias(h), F.col("fingerprint").alias(name))
    three = pairs.drop("text", "edited").join(of("h", "fingerprint"), "h").join(of("edited_sha256", "edited_fingerprint"), "edited_sha256").join(of("after_h", "after_print"), "after_h")

    @F.arrow_udf("struct<near_edited:double,near_next:double>")
    def compared(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        own, changed, following = (from_hex(x.to_pylist()) for x in (a, b, c))
        return pa.StructArray.from_arrays([pa.array(likeness(own, changed)), pa.array(likeness(own, following))], names=["near_edited", "near_next"])

    return three.withColumn("near", compared("fingerprint", "edited_fingerprint", "after_print")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near.near_edited", "near.near_next")
