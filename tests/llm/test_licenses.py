"""Licence scans: phrases against a plain count, runs against every run of the templates, planted and edited templates."""

import random
import re

import pyarrow as pa
import pytest

from driftmend.llm import licenses as lic

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORDS.findall(lower(text))
    places = [(i, label) for phrase, label in lic.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(8)
    some = [*(" ".join(t.split()) for _, t in lic.TEMPLATES), *lic.PHRASES, "ſCC BY", "CC-BY\n4.0 cc by cc by", "Apache\x00License", "MIT Licenseß mit license", "gnu general", "public license"]
    words = [w for s in some for w in s.split()] + ["straße", "日本", "x", "of", "the"]
    found = []
    for _ in range(300):
        parts = [rng.choice(some) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(rng.randrange(6))]
        found.append(rng.choice([" ", "\n", "; "]).join(parts))
    return found + [None, "", " .", "cc by " * 30_000, "mit license cc", "by apache license"]


def test_phrases(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in lic.digest(lic.find_licenses(docs)).collect()}
    assert len(rows) == docs.count()
    for i, t in enumerate(texts()):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_runs_are_the_longest_of_any_template():
    rng = random.Random(2)
    given = tuple((f"l{k}", " ".join(rng.choices("abcd", k=rng.randrange(6, 40)))) for k in range(8))
    model = lic.build(given, {"a b": "ab", "b a b": "bab", "c d": "cd"}, least=3)
    runs = {tuple(w[i:j]) for _, t in given for w in [t.split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)} | {("a", "b"), ("b", "a", "b"), ("b", "a"), ("c", "d")}
    for _ in range(60):
        text = rng.choices("abcde", weights=[5, 5, 5, 5, 1], k=60)
        ids = [model.vocabulary.get(w.encode(), -1) for w in text]
        longest = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(60)]
        want = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= 3 and (i == 59 or longest[i + 1] <= n)]
        named, found = model.streamed(ids)
        assert [(a, b) for a, b, _ in found] == want
        assert sorted(named) == sorted((i, l) for p, l in (("a b", "ab"), ("b a b", "bab"), ("c d", "cd")) for w in [p.split()] for i in range(60) if text[i : i + len(w)] == w)
        for a, b, state in found:
            assert model.ends[state] == sorted((t, j) for t, (_, s) in enumerate(given) for w in [s.split()] for j in range(b - a, len(w) + 1) if w[j - b + a : j] == text[a:b])
        # what scan leaves out has neither
        (all_,) = lic.scan(pa.array([" ".join(text)]), model)
        assert sorted((p["first"], p["label"]) for p in all_["places"]) == sorted(named)


@pytest.mark.parametrize("edits", [0, 2, 5])
def test_edited_templates_are_found(edits):
    rng, model = random.Random(edits), lic.build()
    for label, text in lic.TEMPLATES[:11]:
        words = text.split()
        n = min(edits, len(words) // 12)
        for k in range(n):
            at = (2 * k + 1) * len(words) // (2 * n)
            words[at : at + 1] = rng.choice([[], ["zzz"], ["zzz", words[at]]])
        plain = " ".join(f"w{rng.randrange(500)}" for _ in range(50))
        (x,) = lic.scan(pa.array([f"{plain}\n{' '.join(words)}\n{plain}"]), model)
        own = [s for s in x["spans"] if s["label"] == label]
        assert own and x["score"] >= (0.99 if not edits else 0.6)
        whole = max(own, key=lambda s: s["covered"])
        assert whole["first"] >= 45 and whole["after"] <= 50 + len(lic.tokens(" ".join(words))) + 2
        (y,) = lic.scan(pa.array([plain]), model)
        assert (y["spans"], y["places"], y["score"]) == ([], [], 0.0)


def test_scattered_runs_are_no_span():
    model = lic.build()
    words = lic.TEMPLATES[4][1].split()
    filler = " ".join(f"w{i}" for i in range(40))
    scattered = filler.join(" " + " ".join(words[i : i + 6]) + " " for i in range(0, 48, 6))
    assert not any(s["label"] == "apache" and s["covered"] > 12 for s in lic.scan(pa.array([scattered]), model)[0]["spans"])
    shuffled = " ".join(" ".join(words[i : i + 6]) for i in range(42, -1, -6))
    assert all(s["share"] < 0.9 for s in lic.scan(pa.array([shuffled]), model)[0]["spans"] if s["covered"] > 12)


def test_many_copies_in_one_text_take_time_in_proportion():
    import time

    model, took = lic.build(), []
    for n in (200, 800):
        began = time.time()
        (x,) = lic.scan(pa.array([(lic.TEMPLATES[0][1] + "\n") * n]), model)
        took.append(time.time() - began)
        assert sum(s["label"] == "mit" and s["share"] > 0.99 for s in x["spans"]) == n
    assert took[1] < 10 * took[0] + 1


def test_messy(messy, crowded, nothing):
    run = lambda d: sorted(map(repr, lic.digest(lic.find_licenses(d)).collect()))
    assert run(messy) == run(crowded) and len(run(messy)) == messy.count() and run(nothing) == []
