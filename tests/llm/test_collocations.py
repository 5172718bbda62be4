"""Collocations against a count of every phrase, with fingerprints that collide and with filters that let everything through."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftmend.llm import collocations as c


def brute(rows, least, share, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] = f.get((lang, tuple(words[i : i + size])), 0) + 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in good.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i : i + size]] = max(longer[lang, w[i : i + size]], a)
    found = {}
    for (lang, w), a in good.items():
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not 100 * longer[lang, w] >= share * a:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in found.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"W{i}" for i in range(40)] + ["straße", "日本", "a\x00b", "İx", "-", " "]
    set_phrases = [" ".join(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(25)]
    rows = []
    for _ in range(400):
        parts = [rng.choice(set_phrases) if rng.random() < 0.5 else " \t".join(rng.choices(words, k=3)) for _ in range(rng.randrange(8))]
        rows.append((rng.choice([" ", ". ", "\n", ";", "  "]).join(parts), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (".,;", "fr"), ("one two", "it"), ("x y " * 20_000, "fr"), ("x. y, " * 50, "fr")]


@pytest.mark.parametrize("bits", [64, 10])
def test_against_every_phrase(spark, texts, bits):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    assert told(c.collocations(docs, 8, 80, 30, bits)) == brute(texts, 8, 80, 30)


def test_a_full_filter_lets_all_through(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(c, "bloom", lambda keys, n, most=0: c.Filter(np.full(16, 255, np.uint8)))
    assert told(c.collocations(docs, 8, 60, 50)) == brute(texts, 8, 60, 50)


def test_filter(spark):
    keys = [random.Random(1).randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    found = c.bloom(spark.createDataFrame([(k,) for k in keys], "k long").repartition(4), len(keys))
    assert found.has(np.array(keys, np.int64).view(np.uint64)).all()
    assert found.has(np.arange(100_000, dtype=np.uint64)).mean() < 0.01
    assert not c.bloom(spark.createDataFrame([], "k long"), 0).has(np.arange(10, dtype=np.uint64)).any()


def test_runs_of_slices():
    """Arrays that are parts of others, and texts that begin where the last word ended."""
    texts, langs = pa.array(["zz zz", "a b", "", None, "C d.e f", "g"]).slice(1), pa.array(["xx", "en", "en", "de", "de", "en"]).slice(1)
    r = c.runs(texts, langs)
    pairs = r.whole(2)
    assert r.phrases(r.whole(1), 1) == ["a", "b", "c", "d", "e", "f", "g"] and r.phrases(pairs, 2) == ["a b", "c d", "e f"]
    assert r.text.tolist() == [0, 0, 3, 3, 3, 3, 4] and r.at.tolist() == [0, 1, 0, 1, 2, 3, 0]
    again = c.runs(pa.array(["c d", "a  b"]), pa.array(["de", "en"]))
    assert set(again.fingerprint(again.whole(2), 2).tolist()) <= set(r.fingerprint(pairs, 2).tolist())
    other = c.runs(pa.array(["c d"]), pa.array(["en"]))
    assert not set(other.fingerprint(other.whole(2), 2).tolist()) & set(r.fingerprint(pairs, 2).tolist())


def test_messy(messy, crowded, nothing):
    assert told(c.collocations(messy, 5)) == told(c.collocations(crowded, 5)) == brute([(r["text"], r["lang"]) for r in messy.collect()], 5, 80, 2000)
    assert c.collocations(nothing).collect() == []
