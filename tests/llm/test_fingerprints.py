"""Fingerprints, likeness and neighbours by brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftmend.llm.fingerprints import FEW, HIGH, LEVELS, LOW, SEEDS, STEP, edit_likeness, fingerprint
from driftmend.llm.words import mix
from tests.llm.conftest import words


def plain_print(text, band):
    terms = {xxhash.xxh64_intdigest(w) for w in text.lower().split()}
    terms = terms & band or terms
    hashed = lambda values: f"{max(int(mix(np.array([sum(values) & (2**64 - 1)], np.uint64))[0]) >> 48, 1):04x}" if values else "0000"
    one = lambda t, seed: int(mix(np.array([t], np.uint64), seed)[0])
    out = [hashed([one(t, 1) for t in terms])]
    for level in range(LEVELS):
        for seed in range(SEEDS):
            kept = [v for v in (one(t, 2 + seed) for t in terms) if v % (1 << STEP * (level + 1)) == 0]
            out.append(hashed([v * 0x9E3779B97F4A7C15 for v in kept]))
    return "".join(out)


def plain_likeness(a, b):
    a, b = ([x[i : i + 4] for i in range(0, len(x), 4)] for x in (a, b))
    result = float(a[0] == b[0])
    for level in range(LEVELS):
        pairs = [(x, y) for x, y in list(zip(a, b))[1 + level * SEEDS : 1 + (level + 1) * SEEDS] if (x, y) != ("0000", "0000")]
        if len(pairs) >= FEW:
            result = sum(x == y for x, y in pairs) / len(pairs)
    return result


@pytest.mark.parametrize("kind", ["long", "string", "smallint"])
def test_edits_by_brute_force(spark, kind):
    rng = random.Random(10)
    texts = [words(rng, rng.randrange(0, 300), 3000) for _ in range(120)] + ["same text of some words here"] * 3 + ["", "x"]
    docs = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
    got = {r["doc_id"]: r for r in edit_likeness(docs).collect()}
    joined = {r["doc_id"]: r for r in edit_likeness(docs, broadcast=0).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    count = {}
    for _, t in rows:
        for w in set(t.lower().split()):
            count[w] = count.get(w, 0) + 1
    band = {xxhash.xxh64_intdigest(w) for w, n in count.items() if LOW * len(rows) <= n <= max(HIGH * len(rows), 1)}
    assert len(got) == len(joined) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, changed, following = (plain_print(x, band) for x in (t, edited, after))
        want = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, plain_likeness(own, changed), plain_likeness(own, following))
        assert tuple(got[i]) == tuple(joined[i]) == want
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprint(docs).collect()} == {r["doc_id"]: r["fingerprint"] for r in fingerprint(docs, broadcast=0).collect()} == {i: plain_print(t, band) for i, t in rows}


def test_rows_of_one_id_are_spread(spark):
    """Half the rows without an id, with texts of their own or all alike: a chain through all rows, in several ranges."""
    rows = [(None, f"text {i}") for i in range(300)] + [(None, None)] * 300 + [(i, "other") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = edit_likeness(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in found) == sorted((d is None, d or 0, len(t or "")) for d, t in rows)
    assert sum(r["doc_id"] is None and r["edited_sha256"] == hashlib.sha256(b"").hexdigest() for r in found) == 300
