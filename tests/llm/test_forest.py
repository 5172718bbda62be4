"""The sorted LSH forest against plain prefix groups, and its recall against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from driftmend.llm.ngram_join import FEW, SHORTEST, _forest, join_classes, shingles

TREES, DEPTH, LEAST = 3, 7, 5


@pytest.mark.parametrize(("n", "most"), [(600, 37), (600, 1 << 19), (1, 8), (0, 8)])
def test_prefixes_are_shortened_as_far_as_said(spark, n, most):
    """Also where runs go on over several stretches and partitions."""
    rng = random.Random(51)
    text = lambda: [0 if rng.random() < 0.85 else rng.randrange(3) for _ in range(DEPTH)]
    rows = [[text() for _ in range(TREES)] for _ in range(n)]
    data = [(i + 1, bytearray(np.array(r, ">u2").tobytes())) for i, r in enumerate(rows)]
    got = [tuple(r) for r in _forest(spark.createDataFrame(data, "id long, labels binary").repartition(3), TREES, DEPTH, LEAST, most).collect()]
    nodes, edges = {}, []
    for i, k, head in got:
        if k is not None:
            nodes.setdefault(k, set()).add(i)
        if head is not None:
            edges.append((i, head))
    want_nodes, want_edges = [], []
    for t in range(TREES):
        runs = {d: {} for d in range(SHORTEST, DEPTH + 1)}
        for i, r in enumerate(rows):
            for d in runs:
                runs[d].setdefault(tuple(r[t][:d]), []).append(i + 1)
        want_nodes += [set(m) for m in runs[LEAST].values() if len(m) > 1]
        for i, r in enumerate(rows):
            for d in range(DEPTH, SHORTEST - 1, -1):
                run = runs[d][tuple(r[t][:d])]
                if run[0] != i + 1 and (d >= LEAST or len(run) <= FEW):
                    want_edges.append((i + 1, run[0]))
                    break
    assert sorted(edges) == sorted(want_edges)
    assert sorted(map(sorted, nodes.values())) == sorted(map(sorted, want_nodes))


def test_recall_on_all_pairs(spark):
    """All documents of a table, every pair at 0.8 or more."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    h, starts = shingles(pa.array([r["text"] for r in rows], pa.string()))
    sets = [frozenset(h[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    links = [0] * len(rows)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in by[g]:
                common[j] = common.get(j, 0) + 1
        links[i] = sum(j != i and 5 * c >= 4 * (len(s) + len(sets[j]) - c) for j, c in common.items())
    found = {r["doc_id"]: r["n_links"] for r in join_classes(spark.createDataFrame(rows)).collect()}
    assert sum(links) > 100
    assert sum(found[r["doc_id"]] for r in rows) >= 0.999 * sum(links) and all(found[r["doc_id"]] <= n for r, n in zip(rows, links))


def frames(n, own, rng):
    """Texts of one frame of 170 words and some words of their own: near the threshold, but not linked."""
    frame = [f"f{i}" for i in range(170)]
    return [" ".join([*frame, *(f"o{rng.randrange(10**9)}" for _ in range(own))]) for _ in range(n)]


def plain_links(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := t.split()) else set() for t in texts]
    return [sum(i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_large_nodes_lose_no_link(spark, monkeypatch):
    """Nodes beyond NODE members are compared through lists; the links are those of all pairs."""
    from driftmend.llm import ngram_join

    monkeypatch.setattr(ngram_join, "NODE", 4)
    rng = random.Random(5)
    base = frames(60, 40, rng)
    texts = base + [t + " tail" for t in base[:20]] + [" ".join(t.split()[: 205 - rng.randrange(8)]) for t in base[20:40]] + frames(30, 28, rng) + frames(10, 2, rng)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_links"] for r in join_classes(docs).orderBy("doc_id").collect()] == plain_links(texts)


def test_work_in_a_frame_grows_with_its_members(spark):
    """Rows compared in blocks don't grow with the square of a node."""
    from driftmend.llm.ngram_join import _listed, _sets

    rng, sizes = random.Random(6), []
    for n in (200, 800):
        docs = spark.createDataFrame(list(enumerate(frames(n, 34, rng))), "doc_id long, text string")
        wanted = docs.selectExpr("doc_id id", "doc_id", "xxhash64(text) h")
        from driftmend.llm.ngram_join import _light

        ids = _light(docs, 5, 1, 1).select("doc_id", "id1", "id2")
        sets = _sets(docs, wanted.join(ids, "doc_id"), 5)
        lists = _listed(docs.selectExpr("doc_id id", "doc_id component"), sets, 0.8)
        by = lists.groupBy("k").agg({"short": "max", "id": "count"}).collect()
        sizes.append(sum(r["count(id)"] for r in by if r["max(short)"]))
    assert sizes[1] <= 6 * sizes[0] + 50


def test_files_split_otherwise_on_the_second_read(spark):
    """Stretches are rows of the written table."""
    rng = random.Random(7)
    data = [(i + 1, bytearray(rng.randbytes(TREES * DEPTH * 2) if i % 3 else bytes(TREES * DEPTH * 2))) for i in range(500)]
    sets = spark.createDataFrame(data, "id long, labels binary").repartition(3)
    want = sorted(map(repr, _forest(sets, TREES, DEPTH, LEAST, 37).collect()))
    plan = _forest(sets, TREES, DEPTH, LEAST, 37)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert sorted(map(repr, plan.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
