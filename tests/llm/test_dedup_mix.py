import math
import random

import pytest
from pyspark.sql import functions as F

from driftmend.llm.exact_dedup import LOWER, UPPER, exact_dedup
from driftmend.llm.mixing import mix_plan, mixed, words
from driftmend.llm.queries import oracle_sql, queries

FOLD = str.maketrans(UPPER, LOWER)


@pytest.mark.parametrize("weak", [False, True])
def test_dedup_by_brute_force(spark, weak):
    """Also where the block hash tells almost nothing apart."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbÄ😀") for _ in range(rng.choice([0, 3, 4, 5, 8, 9, 12]))) for _ in range(300)] + ["ab" * 20] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hasher = (lambda c: F.length(c).cast("long") % 2) if weak else F.xxhash64
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t.translate(FOLD), []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs, 4, hasher).collect()} == want


@pytest.mark.parametrize("name", ["op4_mixing", "op6_exact_dedup"])
def test_sql(spark, sf, name):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found, want = queries()[name](spark, sf), duckdb.sql(oracle_sql()[name])
    order = sorted(found.columns)
    assert sorted(tuple(r[c] for c in order) for r in found.collect()) == sorted(want.select(*order).fetchall())


def filled(sizes, weights, epochs):
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        share = sum(weights[s] for s in sizes if s not in clamped)
        new = {s for s in sizes if s not in clamped and epochs * sizes[s] <= left * weights[s] / share}
        if not new or len(clamped | new) == len(sizes):
            return {s: epochs * sizes[s] if s in clamped else left * weights[s] / share for s in sizes}
        clamped |= new


def test_mix_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"])) for i in range(600)] + [(9999, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_plan(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(found) == sorted(mix_plan(docs.repartition(5)).collect())
    got = mixed(docs).groupBy("source").agg(F.sum(words(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {s: n for s, n in taken.items() if n}


def test_repeated_rows_stay_rows(spark):
    """Rows that repeat a doc_id and its text, also in another case, are rows of the result; as the SQL has them."""
    import duckdb

    rows = [(1, "a b"), (1, "a b"), (1, "A b"), (2, "a B"), (3, "x"), (3, "x"), (4, None), (None, ""), (None, ""), (None, "x"), (5, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    found, want = exact_dedup(docs), con.sql(oracle_sql()["op6_exact_dedup"])
    order = sorted(found.columns)
    shown = lambda rows: sorted(map(repr, rows))
    got, sql = [tuple(r[c] for c in order) for r in found.collect()], want.select(*order).fetchall()
    at = order.index("doc_id")
    assert shown(r for r in got if r[at] is not None) == shown(r for r in sql if r[at] is not None) and len(got) == len(rows)
    many = spark.range(10_000).selectExpr("7L doc_id", "'same' text")
    assert exact_dedup(many).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect() == [(7, 7, 10_000, True, 10_000)]


def test_rows_without_an_id_are_spread(spark):
    """They have places of their own in the seeded order, and so have rows that share an id."""
    from driftmend.llm.mixing import _sized

    docs = spark.range(2000).selectExpr("if(id % 2 = 0, null, 5L) doc_id", "concat('w ', id) text", "'s' source")
    assert _sized(docs, 7).select("place.h").distinct().count() == 2000
    taken = {r["taken"] for r in mix_plan(docs).collect()}
    assert taken <= {0, 1, 2, 4, 6}
