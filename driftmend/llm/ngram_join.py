"""N-gram Jaccard join with a MinHash LSH forest.

Documents are sets of hashed word 5-grams; two are linked if their Jaccard similarity is 0.8 or more. Equal
sets are collapsed first, by two 64-bit identities, and numbered. Of each set TREES labels of DEPTH MinHash
values are put into one sorted order, tree by tree: what lies next to each other shares the longest prefix, and
the sets with a common prefix, a node of the tree's trie, are one run of that order.

A set's prefix is shortened from DEPTH as far as it takes: to the longest length at which a pair of just the threshold
still meets in some tree with the target recall (least_depth), and beyond it, down to SHORTEST, for as long as no
more than FEW sets share it, which costs little where documents are rare and finds what the target may still
miss. On the way each set is compared with the head of the longest run that it doesn't lead itself, so a node
of any size gives as many candidates as it has members; what is verified is merged into components. The best-linked
member of each node of the target's length is then compared with those that it isn't connected with, and last, in
blocks, whatever members of a node still are not in one component: all of them in a node of at most NODE members, and in larger
ones those that share an n-gram which a link can't lack (prefix filter). Every candidate is verified on the whole sets.

Links are counted without listing the pairs of a component. Jaccard distance is a metric: with the distances
of two members to their component's pivot, many pairs are links for certain and are counted from a
histogram; many others are impossible; what is left is verified in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmend.llm.common import frugal, global_rank, null_safe, written
from driftmend.llm.words import mix, slices, word_hashes

WORDS, THRESHOLD, RECALL, TREES, DEPTH = 5, 0.8, 0.999, 20, 7
SCALE, BAND, MEMBERS = 1000, 50, 256  # steps of distance; steps in a band of blocks; members of a block
HUBS = 3  # rounds of comparing with the best-linked member of a node
FEW, SHORTEST = 4, 3  # sets that may share a prefix shorter than the target needs; the shortest such prefix
STRETCH = 1 << 17  # rows of the sorted order that are looked at together, and written as one row
NODE = 512  # members of a node up to which they are compared as a whole


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, at most depth, at which a pair at the threshold meets in some tree with this probability."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed n-grams of each text, sorted; first of each text and the end).

    Lower-cased words between ASCII white space. A text of fewer words has one n-gram of all of them, a text
    without words none.
    """
    hashes, starts = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = np.diff(starts)
    padded_n = np.where(n > 0, np.maximum(n, words), 0)
    ends = np.cumsum(padded_n)
    grid = np.zeros(int(padded_n.sum()), np.uint64)
    grid[np.repeat(ends - padded_n - starts[:-1], n) + np.arange(len(hashes))] = hashes
    of = np.repeat(np.arange(len(n)), padded_n)
    total = len(grid) - words + 1
    if total <= 0:
        return np.empty(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    h = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grid[k : k + total], k)
    ok = of[:total] == of[words - 1 :]
    h, of = h[ok], of[:total][ok]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(n) + 1))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[starts[1:]] - total[starts[:-1]]


def set_ids(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit identities of each set."""
    return mix(_sums(mix(h, 101), starts), 103), mix(_sums(mix(h, 102), starts), 104)


def labels(h: np.ndarray, starts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each set and tree the label: depth MinHash values of 16 bits."""
    out = np.zeros((len(starts) - 1, trees, depth), np.uint16)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out
    first = starts[:-1][full]
    with np.errstate(over="ignore"):
        for tree in range(trees):
            for d in range(depth):
                seed = np.uint64((0xD1342543DE82EF95 * (2 * (tree * 64 + d) + 1)) & 0xFFFFFFFFFFFFFFFF)
                v = (h ^ (seed >> np.uint64(7))) * (seed | np.uint64(1))
                out[full, tree, d] = (mix(np.minimum.reduceat(v ^ (v >> np.uint64(32)), first), d) >> np.uint64(48)).astype(np.uint16)
    return out


def _light(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """Of each row: doc_id, hash of its text, its set (id1, id2, n) and labels, one after the other."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, chars=2_000_000):
                h, starts = shingles(part.column("text"), words)
                a, b = set_ids(h, starts)
                flat = labels(h, starts, trees, depth).astype(">u2").tobytes()
                size = trees * depth * 2
                found = pa.array([flat[k : k + size] for k in range(0, len(flat), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(starts)), found], names=["doc_id", "h", "id1", "id2", "n", "labels"])

    return slim.mapInArrow(frugal(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, h long, id1 long, id2 long, n long, labels binary")


def _packed(depth: int, most: int):
    """The sorted rows (id, tree, label) of each partition in stretches of at most `most` rows, a row each: partition, place of the first, ids, trees and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, labels = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at]), pa.array([ids], pa.list_(pa.int64())), pa.array([labels.tobytes()], pa.binary())], names=["p", "i", "ids", "labels"])

        for batch in batches:
            ids, tree = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tree"))
            labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, depth)
            rows = np.column_stack([tree, labels]).astype("<u2")
            while len(ids):
                k = min(len(ids), most - n)
                held.append((ids[:k], rows[:k]))
                ids, rows, n = ids[k:], rows[k:], n + k
                if n == most:
                    yield row(held)
                    held, at, n = [], at + n, 0
        if held:
            yield row(held)

    return run


def _stretches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """((partition, place of the first), ids, tree and label) of the stretches, as they were written, however the files are split."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids")[k].values.to_numpy(zero_copy_only=False)
            rows = np.frombuffer(batch.column("labels")[k].as_py(), "<u2").reshape(-1, depth + 1).astype(np.int32)
            yield (batch.column("p")[k].as_py(), batch.column("i")[k].as_py()), ids, rows


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Values that two labels share from the first on; -1 in different trees."""
    return np.cumprod(one == two, axis=1).sum(1) - 1


class _Runs:
    """The runs with a common prefix of some length in a stretch: of each row its run's number; size and least id of each run."""

    def __init__(self, ids: np.ndarray, shared: np.ndarray, length: int):
        begin = np.concatenate([[True], shared < length])
        first = np.flatnonzero(begin)
        self.of = np.cumsum(begin) - 1
        self.size, self.head = np.diff(np.append(first, len(ids))), np.minimum.reduceat(ids, first)


def _ends(depth: int, least: int):
    """Of each stretch: its ends, and the runs there."""
    lengths = range(min(SHORTEST, least), depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (p, i), ids, rows in _stretches(batches, depth):
            shared = _shared(rows[1:], rows[:-1])
            runs = [_Runs(ids, shared, d) for d in lengths]
            out.append((p, i, len(ids), rows[0].tolist(), rows[-1].tolist(), *([int(getattr(r, what)[k]) for r in runs] for k in (0, -1) for what in ("size", "head"))))
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["p", "i", "n", "first", "last", "first_size", "first_head", "last_size", "last_head"])

    return run


def _joined_ends(ends: list, lengths: int, shortest: int) -> dict[tuple[int, int], list[list[int]]]:
    """(partition, place) of each stretch to its first and last runs' sizes and heads, across all stretches that they go on in."""
    if not ends:
        return {}
    ends = sorted(ends, key=lambda e: (e["p"], e["i"]))
    found = {(e["p"], e["i"]): [list(e[c]) for c in ("first_size", "first_head", "last_size", "last_head")] for e in ends}
    firsts, lasts = (np.array([e[c] for e in ends], np.int64).reshape(len(ends), -1) for c in ("first", "last"))
    shared = _shared(firsts[1:], lasts[:-1]) if len(ends) > 1 else np.empty(0, np.int64)
    for k in range(lengths):
        at = 0
        while at < len(ends):
            to = at  # the run at the end of stretch `at` goes on up to stretch `to`
            while to + 1 < len(ends) and shared[to] >= shortest + k and (to == at or ends[to]["first_size"][k] == ends[to]["n"]):
                to += 1
            if to > at:
                parts = [(ends[at]["last_size"][k], ends[at]["last_head"][k]), *((e["first_size"][k], e["first_head"][k]) for e in ends[at + 1 : to + 1])]
                size, head = sum(s for s, _ in parts), min(h for _, h in parts)
                for e in ends[at : to + 1]:
                    own = found[e["p"], e["i"]]
                    if e is not ends[at] or e["first_size"][k] == e["n"]:
                        own[0][k], own[1][k] = size, head
                    if e is not ends[to] or e["first_size"][k] == e["n"]:
                        own[2][k], own[3][k] = size, head
            at = max(to, at + 1)
    return found


def _forest(sets: DataFrame, trees: int, depth: int, least: int, most: int = STRETCH) -> DataFrame:
    """(id, k, head): for each set in each tree its node k of the target's prefix, if others share it, and the set to compare it with."""
    spark = sets.sparkSession
    parts = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("labels", t * (2 * depth) + 1, F.lit(2 * depth)))
    rows = sets.select("id", F.posexplode(parts).alias("tree", "label")).repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    order = written(rows.mapInArrow(frugal(_packed(depth, most)), "p long, i long, ids array<long>, labels binary"), "join-forest")
    shortest = min(SHORTEST, least)
    # a row for each stretch of the order reaches the driver
    ends = order.mapInArrow(_ends(depth, least), "p long, i long, n long, " + ", ".join(f"{c} array<long>" for c in ("first", "last", "first_size", "first_head", "last_size", "last_head"))).collect()
    known = spark.sparkContext.broadcast(_joined_ends(ends, depth + 1 - shortest, shortest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, rows in _stretches(batches, depth):
            ends = known.value[key]
            shared = _shared(rows[1:], rows[:-1])
            to, size_above = np.full(len(ids), -1, np.int64), None
            for d in range(depth, shortest - 1, -1):
                runs, k = _Runs(ids, shared, d), d - shortest
                runs.size[0], runs.head[0] = ends[0][k], ends[1][k]
                runs.size[-1], runs.head[-1] = ends[2][k], ends[3][k]
                head, size = runs.head[runs.of], runs.size[runs.of]
                here = (to < 0) & (head != ids)
                if d < least:
                    here &= size <= FEW
                to[here] = head[here]
                if d == least:
                    size_above = size
            node = rows[:, 0].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                for d in range(1, least + 1):
                    node = mix(node * np.uint64(0x9E3779B97F4A7C15) + rows[:, d].astype(np.uint64), d)
            keep = (size_above > 1) | (to >= 0)
            out = [pa.array(ids[keep]), pa.array(node[keep].view(np.int64), mask=size_above[keep] < 2), pa.array(to[keep], mask=to[keep] < 0)]
            yield pa.RecordBatch.from_arrays(out, names=["id", "k", "head"])

    return order.mapInArrow(frugal(run), "id long, k long, head long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and its sorted n-grams, for the sets in wanted (doc_id and text hash h of one document with it, id1, id2, id)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    texts = null_safe(texts, wanted, ["doc_id", "h"], "inner").select("id", "id1", "id2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, starts = shingles(part.column("text"), words)
                one, two = (x.view(np.int64) for x in set_ids(h, starts))
                got = (one == part.column("id1").to_numpy()) & (two == part.column("id2").to_numpy())
                grams = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), grams], names=["id", "grams"]).filter(pa.array(got))

    return texts.mapInArrow(frugal(run), "id long, grams array<long>").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are as alike as the threshold."""
    one, two = sets.toDF("a", "ga"), sets.toDF("b", "gb")
    both = F.size(F.array_intersect("ga", "gb")).cast("long")
    per = round(threshold * 1_000_000)
    return pairs.join(one, "a").join(two, "b").filter(both * F.lit(1_000_000) >= (F.size("ga") + F.size("gb") - both) * F.lit(per).cast("long")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of some edge (a, b) is connected with."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "join-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component")
        step = written(labels.union(near).groupBy("id").agg(F.min("component").alias("component")), "join-step")
        jumped = step.join(step.toDF("component", "further"), "component").select("id", "further").toDF("id", "component")
        new = written(jumped, "join-labels")
        changed = not new.exceptAll(labels).isEmpty()
        labels = new
        if not changed:
            return labels


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, id, component) of the members of each node; one without links is a component of its own."""
    return nodes.join(labels, "id", "left").select("k", "id", F.coalesce("component", "id").alias("component"))


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def _common(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(size of the intersection, of the union) of each set of left with each of right."""
    size = [np.array([len(g) for g in part["grams"]], np.int64) for part in (left, right)]
    flat = [np.concatenate([np.asarray(g, np.int64) for g in part["grams"]]) for part in (left, right)]
    known, column = np.unique(np.concatenate(flat), return_inverse=True)
    row = [np.repeat(np.arange(len(s)), s) for s in size]
    columns = [column[: len(flat[0])], column[len(flat[0]) :]]
    common = np.zeros((len(left), len(right)))
    for at in range(0, len(known), 4096):
        part = []
        for r, c, s in zip(row, columns, size):
            here = (c >= at) & (c < at + 4096)
            m = np.zeros((len(s), 4096), np.float32)
            m[r[here], c[here] - at] = 1
            part.append(m)
        common += part[0] @ part[1].T
    common = common.astype(np.int64)
    return common, size[0][:, None] + size[1][None, :] - common


def _block_merges(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the links between the two sides of a block, as many (a, b) as it takes to connect their components."""
    per = round(float(rows["threshold"].iloc[0]) * 1_000_000)
    left, right = (rows[rows["side"] == k].reset_index(drop=True) for k in (0, 1))
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        both, any_ = _common(left, right)
        linked = (both * 1_000_000 >= any_ * per) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for i, j in np.argwhere(linked).tolist():
            one, two = find(int(left["component"][i])), find(int(right["component"][j]))
            if one != two:
                root[one] = two
                out.append((int(left["id"][i]), int(right["id"][j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _blocks_of(left: DataFrame, right: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): merging links between members (k, id, component) of left and right with one k, compared in blocks of bounded size."""
    count = lambda t, c: t.groupBy("k").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias(c))
    size = written(count(left, "x_n").join(count(right, "y_n"), "k"), "join-blocks-of")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(size, "k").select("k", "id", "component", part("x_n").alias("x"), "y_n").select("k", "id", "component", "x", every("y_n").alias("y"), F.lit(0).alias("side"))
    two = right.join(size, "k").select("k", "id", "component", part("y_n").alias("y"), "x_n").select("k", "id", "component", every("x_n").alias("x"), "y", F.lit(1).alias("side"))
    rows = one.unionByName(two).join(sets, "id").select("k", "x", "y", "side", "id", "component", "grams", F.lit(threshold).alias("threshold"))
    return rows.groupBy("k", "x", "y").applyInPandas(_block_merges, "a long, b long").distinct()


def _listed(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(k, id, component, short) for members (id, component): k is an n-gram of the beginning of each set, rarest first.

    Two sets as alike as the threshold share an n-gram of the first (1 - threshold) of the one, and of the still fewer, short, that
    suffice for the smaller one of a pair: what both must have in common is more than is left behind these. Where sets
    share a frame but aren't linked, each has more n-grams of its own than that, so no list of theirs is long.
    """
    per = round(threshold * 1_000_000)
    grams = written(large.join(sets, "id").select("id", "component", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "join-lists-all")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    # n-grams that only one of them has are in no list, but count for the order: they come first
    own = grams.groupBy("id").agg(F.first("size").alias("size"), F.first("component").alias("component"))
    common = grams.select("id", "gram").join(counts, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("common"))
    at = own.join(common, "id").withColumn("alone", F.col("size") - F.size("common"))
    probe = F.col("size") - F.expr(f"cast((cast(size as bigint) * {per} + 999999) div 1000000 as int)") + 1
    short = F.col("size") - F.expr(f"cast((2 * cast(size as bigint) * {per} + {1_000_000 + per - 1}) div {1_000_000 + per} as int)") + 1
    listed = at.select("id", "component", "alone", short.alias("short"), F.posexplode(F.slice("common", 1, F.greatest(probe - F.col("alone"), F.lit(0)))).alias("place", "c"))
    return listed.select(F.col("c.gram").alias("k"), "id", "component", (F.col("alone") + F.col("place") < F.col("short")).alias("short"))


def _merges(named: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect components which meet in a node (k, id, component).

    In a node of up to NODE members those outside its largest component are compared with all members. Members of larger nodes are
    compared with those that share one of the rarest n-grams of their sets, which no link can lack. Both in blocks of bounded size,
    so nothing is emitted but merging links.
    """

    def apart(table: DataFrame, name: str) -> DataFrame:
        """k with several components: its largest, and the number of members."""
        sizes = table.groupBy("k", "component").agg(F.count("*").alias("n"))
        most = sizes.groupBy("k").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
        return written(most.select("k", F.col("most.component").alias("main"), "n"), name)

    mixed = apart(named, "join-mixed")
    small = named.join(mixed.filter(F.col("n") <= NODE), "k")
    found = _blocks_of(small.filter("component <> main").select("k", "id", "component"), small.select("k", "id", "component"), sets, threshold)
    large = mixed.filter(F.col("n") > NODE)
    if large.isEmpty():
        return found
    members = written(named.join(large.select("k"), "k", "left_semi").select("id", "component").distinct(), "join-large")
    lists = written(_listed(members, sets, threshold), "join-lists")
    lists = lists.join(apart(lists, "join-lists-mixed").select("k", "main"), "k")
    pick = lambda what: lists.filter(what).select("k", "id", "component")
    outside = _blocks_of(pick("short and component <> main"), pick("true"), sets, threshold)
    inside = _blocks_of(pick("short and component = main"), pick("component <> main"), sets, threshold)
    return found.union(outside).union(inside).distinct()


def _block_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """Uncertain links between the two blocks of a pair (or within one): id and the documents linked."""
    per = round(float(rows["threshold"].iloc[0]) * 1_000_000)
    limit = int(rows["limit"].iloc[0])
    left = rows[rows["side"] == 0].reset_index(drop=True)
    right = rows[rows["side"] == 1].reset_index(drop=True)
    within = not len(right)
    if within:
        right = left
    both, any_ = _common(left, right)
    linked = both * 1_000_000 >= any_ * per
    linked &= left["q"].to_numpy()[:, None] + right["q"].to_numpy()[None, :] > limit
    if within:
        np.fill_diagonal(linked, False)
    found = [pd.DataFrame({"id": left["id"], "links": linked @ right["copies"].to_numpy()})]
    if not within:
        found.append(pd.DataFrame({"id": right["id"], "links": left["copies"].to_numpy() @ linked}))
    return pd.concat(found)


def _links(members: DataFrame, pivots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, links): documents linked to each member (id, component, copies), those of its own set left out.

    pivots: (component, pivot_id), one member of each component.
    """
    limit = round((1 - threshold) * SCALE)
    pivots = written(pivots.join(sets.toDF("pivot_id", "pivot"), "pivot_id").select("component", "pivot"), "join-pivot-sets")
    both, any_ = F.size(F.array_intersect("grams", "pivot")), F.size("grams") + F.size("pivot")
    away = F.expr(f"cast(({SCALE} * (u - i) + u - 1) div u as int)")
    placed = (
        members.join(sets, "id").join(pivots, "component")
        .withColumn("i", both.cast("long")).withColumn("u", (any_ - F.col("i")).cast("long")).withColumn("q", away)
        .select("id", "component", "copies", "q")
    )
    placed = written(placed, "join-placed")
    histogram = placed.groupBy("component", "q").agg(F.sum("copies").alias("c"), F.count("*").alias("m"))
    histogram = written(histogram.groupBy("component").agg(F.collect_list(F.struct("q", "c", "m")).alias("bins"), F.max("q").alias("top")), "join-histogram")
    at = placed.join(histogram, "component")
    near = F.aggregate(F.filter("bins", lambda b: b["q"] + F.col("q") <= limit), F.lit(0).cast("long"), lambda t, b: t + b["c"])
    certain = at.select("id", (near - F.when(2 * F.col("q") <= limit, F.col("copies")).otherwise(0)).cast("long").alias("links"))

    band = F.floor(F.col("q") / BAND).cast("int")
    many = F.aggregate(F.filter("bins", lambda b: F.floor(b["q"] / BAND).cast("int") == band), F.lit(0).cast("long"), lambda t, b: t + b["m"])
    open_ = at.filter(F.col("q") + F.col("top") > limit).select(
        "id", "component", "copies", "q", band.alias("band"), F.pmod(F.xxhash64("id"), F.ceil(many / MEMBERS)).alias("sub")
    )
    blocks = written(open_.select("component", "band", "sub").distinct(), "join-blocks")
    one, two = blocks.select("component", F.struct("band", "sub").alias("x")), blocks.select("component", F.struct("band", "sub").alias("y"))
    pairs = one.join(two, "component").filter(
        (F.col("x") <= F.col("y")) & ((F.col("x.band") + F.col("y.band")) * BAND + 2 * (BAND - 1) > limit) & ((F.col("y.band") - F.col("x.band") - 1) * BAND + 1 <= limit + 1)
    )
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("own"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("x").alias("own"), F.lit(0).alias("side")), F.struct(F.col("y").alias("own"), F.lit(1).alias("side")))
    )
    places = pairs.select("component", "x", "y", F.explode(sides).alias("s")).select("component", F.col("s.own.band").alias("band"), F.col("s.own.sub").alias("sub"), F.col("s.side").alias("side"), "x", "y")
    rows = open_.join(sets, "id").join(places, ["component", "band", "sub"]).select(
        "component", "x", "y", "side", "id", "copies", "q", "grams", F.lit(threshold).alias("threshold"), F.lit(limit).alias("limit")
    )
    rest = rows.groupBy("component", "x", "y").applyInPandas(_block_counts, "id long, links long")
    return certain.unionByName(rest).groupBy("id").agg(F.sum("links").alias("links"))


def join_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, copy_id, class_id, n_links.

    copy_id is the smallest doc_id with the same set of n-grams, class_id the smallest of the connected
    component, n_links the number of other documents at or above the threshold, those with an equal set among
    them. Texts without words (null, empty) have no n-grams and no links, and each is a class of its own.
    Null doc_ids count as largest. Repeated rows are documents of their own that share a set. An empty table
    gives no rows; other columns are ignored.
    """
    least = least_depth(threshold, recall, trees, depth)
    light = written(_light(docs, words, trees, depth), "join-light")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h"))
    sets = light.filter("n > 0").groupBy("id1", "id2").agg(F.count("*").alias("copies"), first.alias("f"), F.first("labels").alias("labels"))
    sets = sets.select("id1", "id2", "copies", F.col("f.doc_id").alias("doc"), F.col("f.h").alias("h"), "labels")
    sets = global_rank(sets, ["id1", "id2"], "id", "join-sets")

    nodes = written(_forest(sets, trees, depth, least), "join-nodes")
    edges = written(nodes.filter("head is not null").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "join-candidates")
    met = nodes.select("id").union(nodes.filter("head is not null").select("head")).distinct()
    wanted = sets.select("id", "id1", "id2", F.col("doc").alias("doc_id"), "h").join(met, "id", "left_semi")
    grams = written(_sets(docs, wanted, words), "join-grams")
    good = written(_verified(edges, grams, threshold), "join-good")
    labels = components(good)
    nodes = nodes.filter("k is not null").select("id", "k")
    for _ in range(HUBS):
        # the member with the most links, often what the others were copied from, is compared with those not in its component
        named = _named(nodes, labels).join(_degrees(good), "id", "left")
        named = written(named.select("k", "id", "component", F.coalesce("degree", F.lit(0)).alias("degree")), "join-named")
        hubs = written(named.groupBy("k").agg(F.max(F.struct("degree", "id", "component")).alias("hub")), "join-hubs")
        star = named.join(hubs, "k").filter(F.col("component") != F.col("hub.component")).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
        star = written(star.join(edges, ["a", "b"], "left_anti"), "join-star")
        more = written(_verified(star, grams, threshold), "join-more")
        if more.isEmpty():
            break
        edges, good = edges.union(star), good.union(more)
        labels = components(good)
    more = written(_merges(written(_named(nodes, labels), "join-named"), grams, threshold), "join-merges")
    if not more.isEmpty():
        good = good.union(more)
        labels = components(good)

    members = labels.join(sets.select("id", "copies"), "id")
    pivots = labels.join(_degrees(good), "id").groupBy("component").agg(F.max(F.struct("degree", "id")).alias("p")).select("component", F.col("p.id").alias("pivot_id"))
    links = _links(members, written(pivots, "join-pivots"), grams, threshold)
    each = sets.select("id", "id1", "id2", "copies", "doc").join(labels, "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = written(each.select("id1", "id2", "doc", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "join-each")
    classes = written(each.groupBy("component").agg(F.min("doc").alias("class_id")), "join-classes")
    told = written(each.join(classes, "component").select("id1", "id2", F.col("doc").alias("copy_id"), "class_id", "n_links"), "join-told")
    return (
        light.select("doc_id", "id1", "id2", (F.col("n") > 0).alias("full"))
        .join(told, ["id1", "id2"], "left")
        .select("doc_id", *[F.when(F.col("full"), F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("copy_id", "class_id")], F.when(F.col("full"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
    )
