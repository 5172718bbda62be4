"""Toxicity by cumulative-link ordinal regression.

Grades 0 to 2 share one weight vector over sparse text features; two ordered thresholds cut the score,
P(grade <= k) = sigmoid(threshold k - score), and the expected grade is the severity. Features are the letter
sequences of length 4 and 5 in a text's distinct lower-cased words, and those of length 4 that begin a word,
hashed.

Grades come from the labels alone: 0 is clean, 1 toxic, and 2 toxic and of low quality. A text is called toxic from the
probability of grade 1 or more on at which the rows of each half of the sample, judged by a model of the other half, are
told best (F1).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import held_out
from driftmend.llm.words import mix, slices, word_codes

BITS, GRADES = 18, 3
ROWS, CLEAN, LONGEST = 3000, 2, 20_000  # toxic rows used at most, clean ones for each, characters of a row used


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hashed feature) of each feature of some words."""
    points = np.frombuffer(("\n".join(words.to_pylist()) + "\n").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    breaks = points == 10
    word = np.cumsum(breaks) - breaks
    first = np.concatenate([[True], ~letter[:-1]])
    wide = points.astype(np.uint64)
    of, ids = [], []
    with np.errstate(over="ignore"):
        for size in (4, 5):
            n = len(points) - size + 1
            if n <= 0:
                continue
            ok, h = np.ones(n, bool), np.zeros(n, np.uint64)
            for k in range(size):
                ok &= letter[k : n + k]
                h = h * np.uint64(0x100000001B3) + wide[k : n + k]
            for space, keep in ((0, ok), (1, ok & first[:n])) if size == 4 else ((2, ok),):
                at = np.flatnonzero(keep)
                of.append(word[at])
                ids.append((mix(h[at], size * 4 + space) >> np.uint64(64 - BITS)).astype(np.int32))
    return (np.concatenate(of), np.concatenate(ids)) if of else (np.empty(0, np.int64), np.empty(0, np.int32))


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) pairs without repeats, and the words."""
    codes, starts, words = word_codes(pc.utf8_lower(pc.fill_null(texts, "")))
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    pairs = np.unique(of * max(len(words), 1) + codes)
    return pairs // max(len(words), 1), pairs % max(len(words), 1), words


def text_features(texts: pa.Array) -> list[np.ndarray]:
    """The features of each text, once for each distinct word that has them."""
    row, ids = _feature_rows(texts)
    return np.split(ids, np.searchsorted(row, np.arange(1, len(texts)))) if len(texts) else []


def _feature_rows(texts: pa.Array, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), a row for each distinct word of a text that has the feature, sorted by text; of the live features only, if given."""
    of, word, words = _distinct_words(texts)
    w, ids = word_features(words)
    if live is not None:
        w, ids = w[live[ids]], ids[live[ids]]
    by = np.argsort(w, kind="stable")
    w, ids = w[by], ids[by]
    ends = np.searchsorted(w, np.arange(len(words) + 1))
    size = ends[word + 1] - ends[word]
    at = np.repeat(ends[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(of, size), ids[at]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    flag: float = 0.5  # probability of grade 1 or more from which on a text is toxic


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _document_share(features: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Number of the chosen rows that have each feature."""
    have = np.zeros(1 << BITS, np.int64)
    for i in np.flatnonzero(chosen):
        have[np.unique(features[i])] += 1
    return have


def loss(row: np.ndarray, ids: np.ndarray, x: np.ndarray, grades: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log likelihood, its gradients by weights and thresholds) of rows with cells (row, ids, x)."""
    n = max(len(grades), 1)
    score = np.bincount(row, x * w[ids], len(grades))
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    a, b = _sigmoid(edge[grades + 1] - score), _sigmoid(edge[grades] - score)
    a, b = np.where(grades == GRADES - 1, 1.0, a), np.where(grades == 0, 0.0, b)
    p = np.maximum(a - b, 1e-9)
    by_cut = np.bincount(grades + 1, -a * (1 - a) / p, GRADES + 1) + np.bincount(grades, b * (1 - b) / p, GRADES + 1)
    return float(-np.log(p).sum() / n), np.bincount(ids, x * (1 - a - b)[row], len(w)) / n, by_cut[1:-1] / n


def _cells(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each feature of some texts; the value is log(1 + words that have it)."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    ids = np.concatenate([np.empty(0, np.int64), *features]).astype(np.int64)
    cells, n = np.unique(row * (1 << BITS) + ids, return_counts=True)
    return cells >> BITS, cells & ((1 << BITS) - 1), np.log1p(n)


def fit(features: list[np.ndarray], grades: np.ndarray, rounds: int = 400, rate: float = 1.0, l1: float = 1e-3, screened: int = 4000) -> Model:
    """Maximum likelihood with an L1 penalty, by proximal Adagrad on all rows at once.

    Only the features whose share of documents differs most surely between clean and other rows take part.
    """
    bad = max(int((grades > 0).sum()), 1), max(int((grades == 0).sum()), 1)
    one, two = (_document_share(features, grades > 0) / bad[0], _document_share(features, grades == 0) / bad[1])
    both = (one * bad[0] + two * bad[1]) / sum(bad)
    sure = np.abs(one - two) / np.sqrt(np.maximum(both * (1 - both), 1e-6))
    use = np.zeros(1 << BITS, bool)
    use[np.argsort(-sure, kind="stable")[:screened]] = True
    row, ids, x = _cells([f[use[f]] for f in features])
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (len(grades) + GRADES)
    cuts, c2 = np.log(share / (1 - share)), np.full(GRADES - 1, 1e-8)
    for _ in range(rounds):
        _, g, gc = loss(row, ids, x, grades, w, cuts)
        g2 += g * g
        c2 += gc * gc
        step = rate / np.sqrt(g2)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        cuts = np.sort(cuts - rate / np.sqrt(c2) * gc)
    return Model(w, cuts)


def _reached(row: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int, model: Model) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, a row for each of n texts."""
    score = np.bincount(row, x * model.weights[ids], n)
    return 1 - _sigmoid(model.thresholds[None, :] - score[:, None])


def best_flag(p: np.ndarray, bad: np.ndarray) -> float:
    """The probability from which on calling rows toxic has the best F1; of several the middle one, in log odds."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(bad[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + bad.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # rows of one probability are called alike
    best = np.flatnonzero(last & (f1 == f1[last].max()))
    odds = np.log(np.clip(p[order], 1e-9, 1 - 1e-9) / (1 - np.clip(p[order], 1e-9, 1 - 1e-9)))
    upto = np.append(odds[1:], odds[-1] - 1)
    return float(_sigmoid(np.array([(odds[best[0]] + upto[best[-1]]) / 2]))[0])


def fitted(features: list[np.ndarray], grades: np.ndarray) -> Model:
    """A model of all rows, with the flag found on halves that weren't learned from."""
    half, p = np.arange(len(features)) % 2, np.zeros(len(features))
    for k in (0, 1):
        model = fit([features[i] for i in np.flatnonzero(half != k)], grades[half == 1 - k])
        own, live = np.flatnonzero(half == k), model.weights != 0
        p[own] = _reached(*_cells([features[i][live[features[i]]] for i in own]), len(own), model)[:, 0]
    whole = fit(features, grades)
    return Model(whole.weights, whole.thresholds, best_flag(p, grades > 0))


def severities(texts: pa.Array, model: Model) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, a row for each text."""
    row, ids = _feature_rows(texts, model.weights != 0)
    cells, n = np.unique(row * (1 << BITS) + ids, return_counts=True)
    return _reached(cells >> BITS, cells & ((1 << BITS) - 1), np.log1p(n), len(texts), model)


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data = [f.astype("<i4").tobytes() for f in text_features(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(data, pa.binary())], names=["grade", "features"])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Model:
    """Fit on labelled documents that aren't held out (crc32 of doc_id mod 4 is not 2).

    The sample is bounded: about `rows` toxic and CLEAN times as many clean doc_ids, chosen by hash, with one document of at
    most `longest` characters each, whatever the number of rows that repeat an id (the one with the least hash of its
    text). Labels without a document or a value are left out; of several labels of a doc_id the most toxic holds, and
    the lowest quality (null: not low). Without any toxic label every document is clean.
    """
    quality = F.col("quality") if "quality" in labels.columns else F.lit(None).cast("int")
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"), F.min(quality).alias("quality"))
    known = known.select("doc_id", "toxic", F.when(F.col("toxic") == 0, 0).when(F.col("quality") <= 0, 2).otherwise(1).alias("grade"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place, full = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / max(sizes.get(1, 0), 1)) * full)).otherwise(F.lit(min(1.0, CLEAN * rows / max(sizes.get(0, 0), 1)) * full))
    drawn = known.filter(place <= share).select("doc_id", "grade")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= longest)
    # the drawn ids are broadcast: their number is bounded by rows, whatever the number of labels
    one = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = one.orderBy(F.xxhash64("doc_id", "text")).select("text", "grade").mapInArrow(_collect_features, "grade int, features binary").toPandas()
    if not len(found) or not found["grade"].any():
        return Model(np.zeros(1 << BITS), np.full(GRADES - 1, 40.0))
    return fitted([np.frombuffer(b, "<i4") for b in found["features"]], found["grade"].to_numpy())


def with_severity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with severity (expected grade, 0 to 2), toxic (grade 1 or more is as probable as the model's flag), and grade: 0 for
    texts that aren't toxic, else the most likely of 1 and 2.

    These replace columns of the same names. Null and empty texts have no features and the severity of the
    thresholds alone. Rows are independent of each other and keep all other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("severity double, grade int, toxic boolean")
    def tell(texts: pa.Array) -> pa.Array:
        parts = [severities(p.column("text"), shared.value) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        p = np.concatenate([np.empty((0, GRADES - 1)), *parts])
        each = np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)) * -1
        bad = p[:, 0] >= shared.value.flag
        columns = [pa.array(p.sum(1)), pa.array(np.where(bad, 1 + each[:, 1:].argmax(1), 0).astype(np.int32)), pa.array(bad)]
        return pa.StructArray.from_arrays(columns, names=["severity", "grade", "toxic"])

    tell = tell.asNondeterministic()  # it isn't, but else a filter on what it tells would run it twice
    names = [c for c in docs.columns if c not in ("severity", "grade", "toxic", "_told")]
    told = docs.withColumn("_told", tell(F.col("text").cast("string")))
    return told.select(*names, "_told.severity", "_told.grade", "_told.toxic")
