"""Hard negatives against a comparison of all rows, with ties, nulls, repeats and numbers past 64 bits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmend.llm import negatives as neg

TOP = (1 << 63) - 1


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, label, v)."""
    out = []
    for i, (a, la, va) in enumerate(rows):
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), TOP if b is None else b, j, b, lb == la) for j, (b, lb, v) in enumerate(rows) if j != i]
        for s, _, _, p, _ in sorted(x for x in scored if x[4])[:positives]:
            inside = sorted(x for x in scored if not x[4] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, k + 1, x[3], max(-TOP, min(TOP, -s)), max(-TOP, min(TOP, -x[0]))) for k, x in enumerate(inside[:negatives])]
    return sorted(map(repr, out))


def told(df):
    return sorted(repr(tuple(r)) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(kind, n, rng):
    if kind == "ties":
        return [[rng.randrange(-2, 3) for _ in range(3)] for _ in range(n)]
    if kind == "one":
        return [[3, 1, 2]] * n
    if kind == "large":
        return [[rng.randrange(-(1 << 40), 1 << 40) for _ in range(4)] for _ in range(n)]
    if kind == "ragged":
        return [[rng.randrange(-9, 10) for _ in range(rng.randrange(6))] for _ in range(n)]
    return [[int(rng.gauss(20, 60)) for _ in range(12)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "large", "ragged"])
def test_against_all_rows(spark, kind):
    rng = random.Random(kind)
    rows = [(None if rng.random() < 0.05 else rng.randrange(150) if kind == "plain" else i, rng.choice([0, 0, 0, 1, 2, -3, 700 + i]), v) for i, v in enumerate(vectors(kind, 160, rng))]
    if kind != "plain":
        rows = [(i if r[0] is None else r[0], *r[1:]) for i, r in enumerate(rows)]
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").coalesce(1)
    assert told(neg.hard_negatives(table, F.col("vec_id") % 5 == 0, shard=37)) == brute(rows, lambda a: a is not None and a % 5 == 0)


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "large"])
def test_trees_leave_nothing_out(kind):
    rng = random.Random(3)
    x = np.array(vectors(kind, 300, rng), np.int64)
    label = np.array([rng.choice([0, 0, 1, 2, 50 + i]) for i in range(300)])
    tree = neg.pack(x, np.arange(300), np.arange(300) % 250, label, leaf=4, fan=3)
    assert sorted(tree.uid.tolist()) == list(range(300)) and len(tree.levels) > 3
    for low, high, least, most, start, stop in tree.levels[:1]:
        assert all((x[tree.uid[a:b]] >= l).all() and (x[tree.uid[a:b]] <= h).all() for l, h, a, b in zip(low, high, start, stop)) and (stop - start <= 4).all()
    search = neg.Search(tree, x)
    for i in range(0, 300, 7):
        score = [sum(int(a) * int(b) for a, b in zip(x[i], y)) for y in x]
        every = sorted((-s, j % 250, j) for j, s in enumerate(score) if j != i)
        assert search.positives(x[i], int(label[i]), i, 5) == [e for e in every if label[e[2]] == label[i]][:5]
        spans = [neg.window(s) for s in sorted({-e[0] for e in every})[::60]]
        want = [[e for e in every if label[e[2]] != label[i] and a <= -e[0] <= b][:3] for a, b in spans]
        assert search.negatives(x[i], int(label[i]), spans, 3) == want


def test_boxes_are_left_out():
    """Rows of far-off groups are not looked at."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (20, 6))
    x = (centres[np.arange(2000) % 20] + rng.integers(-5, 5, (2000, 6))).astype(np.int64)
    search, seen = neg.Search(neg.pack(x, np.arange(2000), np.arange(2000), np.zeros(2000, np.int64), leaf=16), x), []
    real = search._best
    search._best = lambda found, rows, scores, k: seen.append(len(rows)) or real(found, rows, scores, k)
    walk = search._walk
    search._walk = lambda q, useful, visit: walk(q, useful, lambda rows, scores: seen.append(rows.stop - rows.start) or visit(rows, scores))
    search.positives(x[int(np.argmax((x**2).sum(1)))], 0, -1, 5)
    assert sum(seen) < 700


def test_what_takes_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.001], 1), (1, None, 1), (2, [1.0, None], 1), (3, [inf, 0.0], 1), (4, [nan, 0.0], 1), (5, [1.0, 1.0], None), (None, [1.0], 2), (6, [], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit(1)).withColumn("shard", F.lit("x"))
    assert sorted(map(repr, neg.prepared(table).collect())) == sorted(["Row(vec_id=0, label=1, v=[128, -1])", "Row(vec_id=None, label=2, v=[256])", "Row(vec_id=6, label=2, v=[])"])
    assert neg.hard_negatives(neg.prepared(table), F.col("vec_id") % 50 == 0).collect() == []
    assert neg.hard_negatives(neg.prepared(table.limit(0)), F.col("vec_id") % 50 == 0).collect() == []
