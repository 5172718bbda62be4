"""Trees of manifests: the diff from the root down equals the flat one and leaves equal subtrees unread."""

import random
import re

from pyspark.sql import functions as F

from driftmend.operators.inventory import manifest_diff
from driftmend.operators.tree import differing_directories, store_tree, tree_diff

SCHEMA = "path string, size long, hash string"


def rows_of(rng, n=400):
    names = ["a", "b", "", "x y", "ü", "line\nbreak"]
    paths = {"/".join([rng.choice(names) for _ in range(rng.randrange(0, 5))] + [f"f{rng.randrange(300)}"]) for _ in range(n)} | {"top", "/rooted"}
    return {p: (p, rng.randrange(9), f"h{rng.randrange(4)}") for p in sorted(paths)}


def told(df):
    return sorted(map(tuple, df.select("path", "change").collect()))


def test_against_the_flat_diff(spark):
    rng = random.Random(5)
    one = rows_of(rng)
    two = dict(one)
    for p in rng.sample(sorted(one), 12):
        two.pop(p)
    for p in rng.sample(sorted(two), 9):
        two[p] = (p, two[p][1], None if rng.random() < 0.3 else "other")
    two |= {"new/deep/er/f": ("new/deep/er/f", 1, "h"), "a/b/new": ("a/b/new", None, "h")}
    a, b = (spark.createDataFrame(list(x.values()), SCHEMA) for x in (one, two))
    left, right = store_tree(a), store_tree(b)
    assert told(tree_diff(left, right)) == told(manifest_diff(a, b)) != []
    assert told(tree_diff(right, left)) == told(manifest_diff(b, a))
    assert told(tree_diff(left, left)) == []
    assert left.root().first()[:2] == (len(one), sum(r[1] for r in one.values()))
    again = store_tree(a.repartition(3).orderBy(F.desc("path")))  # the digest knows no order
    assert again.root().first() == left.root().first() != right.root().first()


def test_only_what_differs_is_looked_at(spark):
    rows = [(f"d{i % 20}/s{i % 7}/f{i}", i, "h") for i in range(3000)]
    a, b = store_tree(spark.createDataFrame(rows, SCHEMA)), store_tree(spark.createDataFrame([(p, s, "other" if s == 77 else h) for p, s, h in rows], SCHEMA))
    assert [tuple(r) for r in differing_directories(a, b).collect()] == [(2, "d17/s0")]
    diff = tree_diff(a, b)
    assert told(diff) == [("d17/s0/f77", "changed")]
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*part#\d+ (?:= \d+|IN \(\d+\))", plan)) == 2  # the other folders aren't opened


def test_empty_and_unhashed(spark):
    none, some = store_tree(spark.createDataFrame([], SCHEMA)), store_tree(spark.createDataFrame([("a/b", 1, None), ("a/b", 1, None)], SCHEMA))
    assert none.root().first()[:2] == (0, 0) and told(tree_diff(none, none)) == []
    assert told(tree_diff(none, some)) == [("a/b", "extra")] * 2 and {c for _, c in told(tree_diff(some, some))} == {"unknown"}
