"""Hard negatives from STR-packed R-trees.

Rows are put in order of label and first coordinate and cut into shards of bounded size. Each shard is one R-tree: its rows are
sorted and tiled by one coordinate after the other into leaves, and leaves that follow each other are packed into boxes up to
one root. Over a box each coordinate lies in an interval, so its product with the anchor's does, and the sums of the ends bound
the inner products of all rows in it.

An anchor goes through a tree with a queue, highest bound first. For positives a box is left out if it has no row of
the label or its bound lies strictly below the score of the last of the best so far; for negatives, if for every window it lies
outside the window, or strictly below the last of the best in it. Anchors are sent to the shards (for positives, those
with their label only) and stream through them; the best of the shards meet in one ranking for each anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmend.llm.common import frugal, global_rank, written

LEAF, FAN = 128, 16  # rows of a leaf, boxes of a box
SMALL, LARGE, SHARDS = 4096, 262_144, 1024  # rows of a shard: as many as make so many shards, within these bounds
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
_LIMIT, _DIGITS = (1 << 63) - 1, 10**38 - 1


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """One row of 64-bit integers for each vector; shorter ones end in zeros."""
    sizes, flat = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def _tiles(x: np.ndarray, rows: np.ndarray, dims: list[int], leaf: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: rows sorted by a coordinate and cut into slabs, each of them by the next."""
    leaves = -(-len(rows) // leaf)
    if leaves <= 1 or not dims:
        yield from (rows[i : i + leaf] for i in range(0, len(rows), leaf))
        return
    slabs = max(2, round(leaves ** (1 / len(dims))))
    size = leaf * -(-leaves // slabs)
    rows = rows[np.argsort(x[rows, dims[0]], kind="stable")]
    for i in range(0, len(rows), size):
        yield from _tiles(x, rows[i : i + size], dims[1:], leaf)


@dataclass
class Tree:
    """Rows in the order of leaves; levels of (least, greatest, least label, greatest label, first part, part after) of boxes, leaves first."""

    x: np.ndarray
    uid: np.ndarray
    vec_id: np.ndarray  # the largest number for null
    label: np.ndarray
    levels: list[tuple[np.ndarray, ...]]


def pack(x: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    """The R-tree of some rows (one at least). Labels with a leaf of rows are tiled by themselves, the others together."""
    spread = np.argsort(-x.astype(float).var(0), kind="stable").tolist()
    kinds, which, sizes = np.unique(label, return_inverse=True, return_counts=True)
    group = np.where(sizes[which] >= leaf, which, len(kinds))
    parts = [p for g in np.unique(group) for p in _tiles(x, np.flatnonzero(group == g), spread, leaf)]
    order, stop = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    x, label = x[order], label[order]
    start = stop - [len(p) for p in parts]
    over = lambda f, a: f.reduceat(a, start, axis=0)
    levels = [(over(np.minimum, x), over(np.maximum, x), over(np.minimum, label), over(np.maximum, label), start, stop)]
    while len(levels[-1][4]) > 1:
        low, high, least, most, _, _ = levels[-1]
        start = np.arange(0, len(low), fan)
        levels.append((over(np.minimum, low), over(np.maximum, high), over(np.minimum, least), over(np.maximum, most), start, np.minimum(start + fan, len(low))))
    return Tree(x, uid[order], vec_id[order], label, levels)


def exact(*parts: np.ndarray) -> bool:
    """Are all inner products of these vectors exact in 64-bit floating point?"""
    most = [max(abs(int(p.min(initial=0))), abs(int(p.max(initial=0)))) for p in parts]
    return most[0] * most[-1] * parts[0].shape[1] < 1 << 53


class Search:
    """A tree in floating point where that is exact, else in integers of any size."""

    def __init__(self, tree: Tree, anchors: np.ndarray):
        self.tree = tree
        self.kind = float if exact(tree.x, anchors) else object
        self.x = tree.x.astype(self.kind)
        self.boxes = [(low.astype(self.kind), high.astype(self.kind)) for low, high, *_ in tree.levels]

    def bounds(self, level: int, a: int, b: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product in each of the boxes a to b; up and down: the positive and the negative part of the anchor."""
        low, high = self.boxes[level]
        return low[a:b] @ up + high[a:b] @ down, high[a:b] @ up + low[a:b] @ down

    def _walk(self, q: np.ndarray, useful, visit) -> None:
        """Open boxes by falling bound: useful(level, boxes, least, greatest) says which, visit(rows, scores) sees the rows of leaves."""
        q = q.astype(self.kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        top = len(self.boxes) - 1
        least, most = self.bounds(top, 0, 1, up, down)
        queue = [(-most[0], top, 0, least[0])]
        while queue:
            most, level, box, least = heapq.heappop(queue)
            if not useful(level, slice(box, box + 1), np.array([least]), np.array([-most]))[0]:
                continue
            a, b = (int(self.tree.levels[level][k][box]) for k in (4, 5))
            if not level:
                visit(slice(a, b), self.x[a:b] @ q)
                continue
            least, most = self.bounds(level - 1, a, b, up, down)
            for i in np.flatnonzero(useful(level - 1, slice(a, b), least, most)).tolist():
                heapq.heappush(queue, (-most[i], level - 1, a + i, least[i]))

    def _best(self, found: list[tuple], rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
        """found, (-score, id, row id) each, with further rows: the best k of them."""
        if len(rows) > k:  # rows that score less than the k-th of their own can't be among them
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[some], scores[some]
        new = zip((-scores).tolist(), self.tree.vec_id[rows].tolist(), self.tree.uid[rows].tolist())
        return sorted([*found, *new])[:k]

    def positives(self, q: np.ndarray, label: int, own: int, k: int) -> list[tuple]:
        """The best k rows of a label but the one with the row id own."""
        found: list[tuple] = []
        levels, t = self.tree.levels, self.tree

        def useful(level, boxes, least, most):
            there = (levels[level][2][boxes] <= label) & (levels[level][3][boxes] >= label)
            return there & (most >= -found[-1][0]) if len(found) == k else there

        def visit(rows, scores):
            nonlocal found
            some = (t.label[rows] == label) & (t.uid[rows] != own)
            if len(found) == k:
                some &= scores >= -found[-1][0]
            at = np.flatnonzero(some)
            found = self._best(found, at + rows.start, scores[at], k)

        self._walk(q, useful, visit)
        return found

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """For each window (least, greatest score) the best k rows in it of other labels."""
        found: list[list[tuple]] = [[] for _ in windows]
        levels, t = self.tree.levels, self.tree
        floor = [low for low, _ in windows]

        def useful(level, boxes, least, most):
            other = (levels[level][2][boxes] != label) | (levels[level][3][boxes] != label)
            some = np.zeros(len(other), bool)
            for low, (_, high) in zip(floor, windows):
                some |= (most >= low) & (least <= high)
            return other & some

        def visit(rows, scores):
            other = t.label[rows] != label
            for w, (_, high) in enumerate(windows):
                at = np.flatnonzero(other & (scores >= floor[w]) & (scores <= high))
                if len(at):
                    found[w] = self._best(found[w], at + rows.start, scores[at], k)
                    if len(found[w]) == k:
                        floor[w] = max(floor[w], -found[w][-1][0])

        self._walk(q, useful, visit)
        return found


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The integers n with low * score <= 100 n <= high * score."""
    return -(-low * score // 100), high * score // 100


@dataclass
class _Shard:
    """The rows of a shard as they come in, and then its tree."""

    number: int
    parts: list[tuple[np.ndarray, ...]]
    tree: Tree | None = None

    def packed(self) -> Tree | None:
        if self.tree is None and self.parts:
            width = max(p[0].shape[1] for p in self.parts)
            self.tree = pack(np.concatenate([_wide(p[0], width) for p in self.parts]), *(np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3)))
            self.parts = []
        return self.tree


_FOUND = "anchor long, place int, score decimal(38,0), vec_id long, uid long"


def _answered(asked: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """(anchor, place, score, vec_id, uid): the best of each shard for each anchor, and for each of its positives if it comes with their scores.

    asked: rows of shards (query 0) and anchors (query 1), brought together and sorted.
    """

    def answer(tree: Tree, batch: pa.RecordBatch) -> list[tuple]:
        v = _wide(matrix(batch.column("v")), tree.x.shape[1])
        if v.shape[1] > tree.x.shape[1]:
            tree = pack(_wide(tree.x, v.shape[1]), tree.uid, tree.vec_id, tree.label)
        search, out = Search(tree, v), []
        for i, (uid, label, scores) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("label").to_pylist(), batch.column("scores").to_pylist())):
            if scores is None:
                lists = [(0, search.positives(v[i], label, uid, positives))]
            else:
                spans = [(j, *window(int(s), low, high)) for j, s in enumerate(scores)]
                spans = [s for s in spans if s[1] <= s[2]]
                lists = zip([s[0] for s in spans], search.negatives(v[i], label, [s[1:] for s in spans], negatives)) if spans else []
            out += [(uid, j, max(-_DIGITS, min(_DIGITS, int(-s))), None if vec == _LIMIT else vec, row) for j, found in lists for s, vec, row in found]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Shard(-1, [])
        for batch in batches:
            shard, query = (batch.column(c).to_numpy() for c in ("shard", "query"))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(query) != 0)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard[a] != now.number:
                    now = _Shard(int(shard[a]), [])
                part = batch.slice(a, b - a)
                if not query[a]:
                    ids = part.column("vec_id").fill_null(_LIMIT).to_numpy()
                    now.parts.append((matrix(part.column("v")), part.column("uid").to_numpy(), ids, part.column("label").to_numpy()))
                elif (tree := now.packed()) is not None:
                    columns = [list(c) for c in zip(*answer(tree, part))] or [[]] * 5
                    kinds = (pa.int64(), pa.int32(), pa.decimal128(38, 0), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "place", "score", "vec_id", "uid"])

    return asked.repartition("shard").sortWithinPartitions("shard", "query").mapInArrow(frugal(run), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prepared(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with floor(scale * x) of each component."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, v).

    anchors: which rows are. The positives of an anchor are the best other rows of its label; for each of them the best rows of other
    labels are told whose score s has low * p <= 100 s <= high * p for the positive's score p. Scores are exact inner
    products of integers, beyond 64 bits the ends of their range; ties go to the smaller vec_id, null last. A row is
    another than the anchor even if it repeats it, and anchors that repeat each other are told each. Shorter vectors end in
    zeros. A label that occurs once has no positive, and a positive without a row in its window no negative: these
    have no rows here. An empty table gives none. shard: rows of a tree at most.
    """
    rows = written(rows.select("vec_id", "label", "v").withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    n = rows.count()
    size = shard or min(max(-(-n // SHARDS), SMALL), LARGE)
    placed = global_rank(rows.withColumn("first", F.coalesce(F.get("v", F.lit(0)), F.lit(0))), ["label", "first", "vec_id", "uid"], "rank", "negatives-ordered")
    placed = placed.withColumn("shard", F.expr(f"(rank - 1) div {size}")).drop("rank", "first")
    span = written(placed.groupBy("label").agg(F.min("shard").alias("begin"), F.max("shard").alias("end")), "negatives-labels")
    asking = placed.filter(anchors).drop("shard").join(span, "label")
    none = F.lit(None).cast("array<decimal(38,0)>")
    ask = lambda which, shards, scores: which.withColumn("shard", F.explode(shards)).select("shard", F.lit(1).alias("query"), "uid", "vec_id", "label", "v", scores.alias("scores"))
    held_rows = placed.select("shard", F.lit(0).alias("query"), "uid", "vec_id", "label", "v", none.alias("scores"))

    found = _answered(held_rows.unionByName(ask(asking, F.sequence("begin", "end"), none)), positives, negatives, low, high)
    best = written(_ranked(found, positives).select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    scores = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("s")).select(F.col("anchor").alias("uid"), F.transform("s", lambda x: x["positive_score"]).alias("told"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(-(-n // size) - 1, 0)).cast("long"))
    others = F.filter(every, lambda s: (s <= F.col("begin")) | (s >= F.col("end")))  # shards between these hold the label alone
    found = _answered(held_rows.unionByName(ask(asking.join(scores, "uid"), others, F.col("told"))), positives, negatives, low, high)
    far = _ranked(found, negatives).select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asking.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    long = lambda c: F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.col(c))).cast("long").alias(c)
    return far.join(best, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", long("positive_score"), long("negative_score"))
