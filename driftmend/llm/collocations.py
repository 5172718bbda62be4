"""Phrase collocations by Rabin-Karp fingerprints.

Texts are read as bytes: one table tells words, blanks and ends of pieces apart, each distinct word is hashed to 128 bits,
and prefix polynomials over the words of many texts give the fingerprint of every run of 1 to 4 words within a piece, in
either half, at the cost of a subtraction and a product. Five passes read the texts:

1. words by fingerprint; those that occur often enough pass on, in a Bloom filter of bounded size;
2. pairs of such words, likewise;
3. runs of 3 both of whose pairs pass, likewise;
4. runs of 4 both of whose runs of 3 pass;
5. the texts of the frequent ones alone, read where the marks say.

What is shuffled in passes 1 to 4 is a fingerprint, its number and a mark: 20 bits of the second half, and 12 bits that name the
place of one occurrence. So each length is counted once, and no pass tells again in each task what another has found frequent.

A filter only lets too much through, which the counts after it put right. A fingerprint whose marks hold two second halves stands
for several phrases: these are counted again by their texts.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmend.llm.common import frugal, held, written
from driftmend.llm.words import cut_words, mix, slices

LEAST, SHARE, TOP, LONGEST = 30, 80, 2000, 4
NO_LANG = "und"
MOST_BITS = 1 << 29  # of a filter: 64 MB
CHUNK = 4096  # bytes of a filter that are filled as one
HASHES = 3
_HELD, _CHARS = 500_000, 1_000_000  # rows that a worker sums up before it lets go of them; bytes of text that it reads at a time
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BLANK, _END = 1, 2
_PLACE = 12  # bits of a mark that name a place


@functools.cache
def _kinds() -> np.ndarray:
    """What each byte is: of a word, a blank between words, or the end of a piece."""
    table = np.zeros(256, np.uint8)
    table[[0x20, 0x09]] = _BLANK
    table[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
    return table


@functools.lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    row = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
    return row(base), row(pow(base, -1, 1 << 64))


@dataclass
class Runs:
    """The words of some texts, and what fingerprints of their runs are made from."""

    words: pa.Array  # distinct
    codes: np.ndarray  # of each word, its place in words
    piece: np.ndarray  # of each word
    text: np.ndarray  # of each word, the number of its text
    at: np.ndarray  # of each word, its number in its text
    tongues: list[str]  # languages
    tongue: np.ndarray  # of each text, its language's number
    salts: tuple[np.ndarray, np.ndarray]  # of each text, from its language
    named: np.ndarray  # hash of each text and its language
    prefix: list[np.ndarray]
    bits: int

    def whole(self, n: int) -> np.ndarray:
        """Where runs of n words lie in one piece."""
        m = max(len(self.codes) - n + 1, 0)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :][:m])

    def joint(self, at: np.ndarray, n: int) -> np.ndarray:
        """Where runs of n words lie in one piece both of whose runs of n - 1 words are among those at the given places."""
        there = np.zeros(len(self.codes) + 1, bool)
        there[at] = True
        at = at[there[at + 1]]
        return at[self.piece[at] == self.piece[at + n - 1]]

    def half(self, which: int, at: np.ndarray, n: int) -> np.ndarray:
        powers = _powers(_BASES[which], _room(len(self.codes)))[0]
        with np.errstate(over="ignore"):
            return mix((self.prefix[which][at + n] - self.prefix[which][at]) * powers[at + n] + self.salts[which][self.text[at]], n)

    def fingerprint(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.half(0, at, n) >> np.uint64(64 - self.bits)

    def pointer(self, at: np.ndarray) -> np.ndarray:
        """A name of few bits for the place of each run: its text and the number of its first word."""
        return mix(self.named[self.text[at]] ^ mix(self.at[at].astype(np.uint64), 11), 12) >> np.uint64(64 - _PLACE)

    def mark(self, at: np.ndarray, n: int) -> np.ndarray:
        """The first bits of the second half of each run, then its pointer."""
        return (self.half(1, at, n) >> np.uint64(32) >> np.uint64(_PLACE) << np.uint64(_PLACE) | self.pointer(at)).astype(np.uint32).view(np.int32)

    def phrases(self, at: np.ndarray, n: int) -> list[str]:
        rows = self.codes[at[:, None] + np.arange(n)]
        used, place = np.unique(rows, return_inverse=True)
        words = np.array(self.words.take(pa.array(used)).cast(pa.string()).to_pylist(), object)
        return [" ".join(r) for r in words[place.reshape(rows.shape)].tolist()]


def _room(n: int) -> int:
    """Powers are made for the next power of two, so that many slices share them."""
    return 1 << max(n + LONGEST, 2).bit_length()


def runs(texts: pa.Array, langs: pa.Array, bits: int = 64) -> Runs:
    """Words of texts (null: empty), A-Z in lower case, per language (no nulls)."""
    found = cut_words(texts, _kinds())
    halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in found.words.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    named_langs = langs.dictionary_encode()
    tongues, tongue = named_langs.dictionary.to_pylist(), named_langs.indices.to_numpy(zero_copy_only=False)
    salt = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in tongues), ">u8").astype(np.uint64).reshape(-1, 2)[tongue]
    named = np.fromiter((xxhash.xxh3_64_intdigest(t or "") for t in texts.to_pylist()), np.uint64, len(texts)) ^ salt[:, 0]
    prefix = []
    with np.errstate(over="ignore"):
        for k, base in enumerate(_BASES):
            inverse = _powers(base, _room(len(found.codes)))[1]
            prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(halves[found.codes, k] * inverse[: len(found.codes)])]))
    ends = np.union1d(np.flatnonzero(found.kind == _END), found.firsts)
    return Runs(found.words, found.codes, np.searchsorted(ends, found.start, "right"), found.text, found.at, tongues, tongue, (salt[:, 0], salt[:, 1]), named, prefix, bits)


class Filter:
    """A Bloom filter over 64-bit keys; without bits nothing passes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def place(keys: np.ndarray, k: int, size: int) -> np.ndarray:
        """Of each key the k-th place of HASHES, of so many (a power of two)."""
        return mix(keys, 21 + k) & np.uint64(size - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for k in range(HASHES):  # what fails at one place is not looked for at the next
            at = self.place(keys[left], k, 8 * len(self.bits))
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        found[left] = True
        return found




def bloom(keys: DataFrame, n: int, most: int = MOST_BITS) -> Filter:
    """A filter over the n values of the only column (long) of keys: 24 bits a key, in all at most `most`.

    The bits are set in tasks; what reaches the driver is the filter itself, whose size has that bound.
    """
    size = min(most, 1 << max(24 * n, 8 * CHUNK).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([Filter.place(own, k, size) for k in range(HASHES)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // (8 * CHUNK)).astype(np.int32)), pa.array((at % (8 * CHUNK)).astype(np.int32))], names=["chunk", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = (c.to_numpy() for c in batch.columns)
            for c in np.unique(chunk).tolist():
                own = chunks.setdefault(c, np.zeros(8 * CHUNK, bool))
                own[bit[chunk == c]] = True
        for c, own in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    filled = keys.mapInArrow(place, "chunk int, bit int").repartition("chunk").mapInArrow(frugal(fill), "chunk int, bits binary")
    whole = np.zeros(size // 8, np.uint8)
    for r in filled.toLocalIterator():
        whole[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], np.uint8)
    return Filter(whole)


def _summed(keys: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each key: the sum of n, the least of low and the greatest of high."""
    if not len(keys):
        return keys, n, low, high
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


class _Tally:
    """One row for each key, summed up when many have come in."""

    def __init__(self):
        self.parts, self.new, self.size = [(np.empty(0, np.uint64), np.empty(0, np.int64), *[np.empty(0, np.int32)] * 2)], 0, 0

    def add(self, keys: np.ndarray, marks: np.ndarray) -> None:
        self.parts.append((keys, np.ones(len(keys), np.int64), marks, marks))
        self.new += len(keys)
        if self.new > _HELD // 2:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """(key, n, least mark, greatest mark)"""
        whole = _summed(*(np.concatenate(c) for c in zip(*self.parts)))
        self.parts, self.new, self.size = [whole], 0, len(whole[0])
        return whole


def _each(batch: pa.RecordBatch, bits: int) -> Iterator[Runs]:
    for part in slices(batch, chars=_CHARS):
        yield runs(part.column("text"), part.column("lang"), bits)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counts(docs: DataFrame, bits: int, *filters: Filter) -> DataFrame:
    """(fp, lang, n, low, high): of all words; with filters of words, pairs, ... that pass, of the runs of one word more, all parts of which pass.

    low and high are the least and the greatest mark. lang is null but in the rows without fp, which hold the number of words of
    each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = ["fp", "mark", "lang", "n"]

    def rows(keys: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        other = np.flatnonzero(low >> _PLACE != high >> _PLACE)  # of these a second row, which counts nothing, has the other half
        keys, marks, n = np.concatenate([keys, keys[other]]), np.concatenate([low, high[other]]), np.concatenate([n, np.zeros(len(other), np.int64)])
        return pa.RecordBatch.from_arrays([_long(keys), pa.array(marks), pa.nulls(len(keys), pa.string()), pa.array(n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = held(getattr, shared, "value"), Counter()
        tally, length = _Tally(), len(known) + 1
        for batch in batches:
            for r in _each(batch, bits):
                if not known:
                    totals.update(dict(zip(r.tongues, np.bincount(r.tongue[r.text], minlength=len(r.tongues)).tolist())))
                at = r.whole(1)
                for n, passing in enumerate(known, 1):
                    at = r.joint(at[passing.has(r.fingerprint(at, n))], n + 1)
                tally.add(r.fingerprint(at, length), r.mark(at, length))
                if tally.size > _HELD:
                    yield rows(*tally.rows())
                    tally = _Tally()
        yield rows(*tally.rows())
        none = pa.nulls(len(totals), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=names)

    # workers have summed up what they can, so rows are dealt out as they are, without another table of sums before that
    found = docs.mapInArrow(frugal(run), "fp long, mark int, lang string, n long")
    return found.repartition("fp", "lang").groupBy("fp", "lang").agg(F.sum("n").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"))


def _passing(r: Runs, words: Filter, longer: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, fingerprints) of the runs of each length that pass, as do both runs of one word less in them."""
    at = r.whole(1)
    for n in range(1, LONGEST + 1):
        at = r.joint(at, n) if n > 1 else at
        own = r.fingerprint(at, n)
        if n < LONGEST:
            passed = (words if n == 1 else longer).has(own)
            at, own = at[passed], own[passed]
        yield n, at, own


def _place(own: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    return mix(own ^ mix(pointer, 31), 32)


def _texts(docs: DataFrame, bits: int, words: Filter, longer: Filter, places: Filter) -> DataFrame:
    """(fp, pointer, lang, len, phrase) at the places that pass; a worker tells each of them once."""
    shared = docs.sparkSession.sparkContext.broadcast((words, longer, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *filters, wanted = held(getattr, shared, "value")
        told: list[set[int]] = [set() for _ in range(LONGEST + 1)]  # by length
        for batch in batches:
            for part in slices(batch, chars=_CHARS):
                r = runs(part.column("text"), part.column("lang"), bits)
                for n, at, own in _passing(r, *filters):
                    pointer = r.pointer(at)
                    keys = _place(own, pointer)
                    some = np.flatnonzero(wanted.has(keys))
                    some = some[np.unique(keys[some], return_index=True)[1]]
                    some = np.array([i for i, k in zip(some.tolist(), keys[some].tolist()) if k not in told[n]], np.int64)
                    told[n].update(keys[some].tolist())
                    if sum(map(len, told)) > _HELD:
                        told[n].clear()
                    lang = part.column("lang").take(pa.array(r.text[at[some]]))
                    yield pa.RecordBatch.from_arrays([_long(own[some]), pa.array(pointer[some].astype(np.int32)), lang, pa.array(np.full(len(some), n, np.int32)), pa.array(r.phrases(at[some], n), pa.string())], names=["fp", "pointer", "lang", "len", "phrase"])

    return docs.mapInArrow(frugal(run), "fp long, pointer int, lang string, len int, phrase string")


def _recounted(docs: DataFrame, bits: int, words: Filter, longer: Filter, several: Filter) -> DataFrame:
    """(fp, lang, len, phrase, n) by text, of the runs with a fingerprint that passes."""
    shared = docs.sparkSession.sparkContext.broadcast((words, longer, several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *filters, wanted = held(getattr, shared, "value")
        for batch in batches:
            for part in slices(batch, chars=_CHARS):
                r, found = runs(part.column("text"), part.column("lang"), bits), Counter()
                for n, at, own in _passing(r, *filters):
                    some = wanted.has(own)
                    langs = part.column("lang").take(pa.array(r.text[at[some]])).to_pylist()
                    found.update(zip(own[some].view(np.int64).tolist(), langs, [n] * len(langs), r.phrases(at[some], n)))
                rows = [list(c) for c in zip(*found)] or [[]] * 4
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds)), pa.array(list(found.values()), pa.int64())], names=["fp", "lang", "len", "phrase", "n"])

    return docs.mapInArrow(frugal(run), "fp long, lang string, len int, phrase string, n long").groupBy("fp", "lang", "len", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, len, phrase, f) of the phrases of 1 to 4 words that occur at least so often in a language; and (lang, n), its words.

    Null texts are empty, null languages `und`. Phrases are words with single spaces between them. bits: of a fingerprint; with
    few, more phrases meet in one and are counted by their texts.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    often = lambda name, *filters: written(_counts(docs, bits, *filters).filter((F.col("n") >= least) | F.col("fp").isNull()), name)
    first = often("phrase-words")
    one, totals = first.filter("fp is not null"), first.filter("fp is null").select("lang", "n")
    words = bloom(one.select("fp"), one.count())
    two = often("phrase-pairs", words)
    pairs = two.count()
    three = often("phrase-triples", words, bloom(two.select("fp"), pairs))
    longer = bloom(two.select("fp").union(three.select("fp")), pairs + three.count())
    four = often("phrase-fours", words, longer, longer)
    found = functools.reduce(DataFrame.union, [t.filter("fp is not null").withColumn("len", F.lit(k)) for k, t in enumerate((one, two, three, four), 1)])
    half = lambda mark: F.shiftright(mark, _PLACE)
    alone = found.filter(half("low") == half("high")).select("fp", "len", "n", F.col("low").bitwiseAND((1 << _PLACE) - 1).alias("pointer"))
    several = found.filter(half("low") != half("high")).select("fp", "len")
    texts = _texts(docs, bits, words, longer, bloom(alone.select("fp", "pointer").mapInArrow(_places, "key long"), alone.count()))
    texts = texts.join(alone, ["fp", "len", "pointer"]).groupBy("fp", "len").agg(*[F.first(c).alias(c) for c in ("lang", "phrase", "n")]).drop("fp")
    if n := several.count():
        again = _recounted(docs, bits, words, longer, bloom(several.select("fp"), n)).join(several, ["fp", "len"], "left_semi")
        texts = texts.unionByName(again.filter(F.col("n") >= least).drop("fp"))
    return written(texts.withColumnRenamed("n", "f"), "phrases"), totals


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, pointer = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("fp", "pointer"))
        yield pa.RecordBatch.from_arrays([_long(_place(own, pointer))], names=["key"])


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 4 words of each language.

    a, l and r are the numbers of a phrase, of its part before the lowest-scoring cut and of that after it, n all words of
    the language, score floor(2,000,000 a / (l + r)) at that cut (ties: the first cut). A phrase inside a longer candidate with share
    percent or more of its number is dropped. Ties of score go to the larger a, then to the phrase by its bytes. Null texts
    are empty, null languages `und`; repeated rows count each; very long texts are read whole; an empty table gives no rows; other
    columns are ignored. Scores are computed in decimals of 38 digits.
    """
    known, totals = frequent_phrases(docs, least, bits)
    mine = known.filter("len > 1").withColumn("w", F.split("phrase", " "))
    part = lambda k, n: F.array_join(F.slice("w", k, n), " ")
    cut = mine.select("lang", "phrase", "f", "w", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("len") - F.col("k")).alias("tail"))
    count = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cut = cut.join(count("head", "l"), ["lang", "head"]).join(count("tail", "r"), ["lang", "tail"])
    cut = cut.withColumn("score", F.expr("(2000000 * cast(f as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    low = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "f")).alias("x")).select("lang", "phrase", F.col("x.f").alias("a"), "x.l", "x.r", "x.score")
    inner = mine.filter("len > 2").select("lang", "f", "w", "len", F.explode(F.sequence(F.lit(2), F.col("len") - 1)).alias("size"))
    inner = inner.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("size") + 1)).alias("k"))
    inner = inner.groupBy("lang", part(F.col("k"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = low.join(inner, ["lang", "phrase"], "left").filter(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {share} * cast(a as decimal(20, 0))")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are first ranked in parts, so that no task sorts more than the best of each
    first = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
