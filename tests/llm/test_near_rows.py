"""The near_duplicates stage decides by row, by brute force."""

import hashlib

import corpus_pipeline
from tests.llm.conftest import COLUMNS


def _grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _one_of_each(rows):
    """The rows that stay: those without words, and the first of each component at a Jaccard similarity of 0.8."""
    sets = [_grams(r["text"]) for r in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                of = [of[j] if x == of[i] else x for x in of]
    order = lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, hashlib.sha256((rows[i]["text"] or "").encode()).digest())
    first = {}
    for i in sorted(range(len(rows)), key=order):
        first.setdefault(of[i], i)
    return [rows[i] for i in first.values()]


def test_near_stage_decides_by_row(spark, messy):
    text = " ".join(f"v{i}" for i in range(60))
    more = [(None, text, "en", "s0", 1), (None, text + " v", "en", "s0", 1), (None, "quite another text of seven words", "en", "s0", 1), (7, text, "en", "s0", 1), (900, "  ", "en", "s0", 2), (900, "  ", "en", "s0", 2), (901, text + " w", "en", "s0", 1), (901, "a clean text under a repeated doc id", "en", "s0", 1)]
    docs = messy.unionByName(spark.createDataFrame(more, COLUMNS))
    found = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted(map(repr, found)) == sorted(map(repr, _one_of_each(docs.collect())))
