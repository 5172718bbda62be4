import base64
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftmend.llm import huffman, language, toxicity
from driftmend.llm.ngram_join import join_classes, least_depth
from driftmend.llm.packing import differencing, pack, sequences, windows_for
from driftmend.llm.secrets import KINDS, digest, find_secrets, spans
from driftmend.llm.tokens import PieceTokenizer
from tests.llm.conftest import words

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def der(tag, *parts):
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2)) + body


def test_secrets(spark):
    rng = random.Random(3)
    bits = ["password", "PassWd", "ſecret", "secret", "token", "api_key", "APIKEY", "K", "\"", "'", " ", "  ", ":", "=", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "😀", "\n", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    key = der(0x30, der(2, b"\0"), der(2, b"\0" + os.urandom(128)), der(2, b"\1\0\1"))
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'a': 1})}.c2ln"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END RSA PRIVATE KEY-----"
    planted = {"jwt": f"é {token} x", "der": "é " + base64.b64encode(key).decode(), "pem": pem}
    for kind, t in planted.items():
        assert kind in {KINDS[s[1]] for s in spans(t)}, kind
    for t in ("é " + part({"typ": "JWT"}) + "." + part({}) + ".x", base64.b64encode(key[:-1]).decode(), base64.b64encode(os.urandom(300)).decode()):
        assert not any(s[1] > 2 for s in spans(t))
    rows = list(enumerate(texts + list(planted.values())))
    for r in digest(find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        want = base_spans(rows[r["doc_id"]][1])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_tokens_equal_the_library(name, spaced):
    rng = random.Random(4)
    bits = list("ab ,.'\n\n\t   ") + [" ", "é", "ß", "　", "日", "😀", "\x1c", "\r", "Σ", "ς", "İ", "é", "́", "1", "\0", "<|endoftext|>", "'s", "n't"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + [None, "", " ", "  ", "\n", " \n "]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    model = PieceTokenizer(public_tokenizers.path(name), spaced, added=True)
    for _ in range(2):
        ids, at = model.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        model._trim()


def _plain_ids(docs, name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    rows = docs.select("doc_id", "text").collect()
    return [(r["doc_id"], np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4")) for r in rows]


def test_packing(spark, messy):
    sizes = [random.Random(6).randrange(1, 513) for _ in range(300)]
    for w in (windows_for(sizes, 1024), differencing(sizes, 90)):
        assert sorted(i for x in w for i in x) == list(range(300))
    assert max(sum(sizes[i] for i in x) for x in windows_for(sizes, 1024)) <= 1024
    even = [sum(sizes[i] for i in x) for x in differencing(sizes, 60)]
    assert max(even) - min(even) <= 12
    found = pack(messy, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    rows = found.collect()
    want = sorted((repr(d), len(i), zlib.crc32(i.tobytes())) for d, i in _plain_ids(messy, "byte_bpe_50k.json", 0))
    short = sorted((repr(r["doc_id"]), r["length"], r["ids_crc32"]) for r in rows if r["length"] == r["doc_tokens"])
    assert set(short) <= set(want) and sum(r["length"] for r in rows) == sum(w[1] for w in want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for s in by.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    for r in sequences(found).collect():
        ids = np.frombuffer(b"".join(x[2] for x in sorted(by[r["sequence_id"]])), "<u4").tolist()
        n = len(ids)
        assert r["size"] == n and r["ids"] == ids + [0] * (0 if n & (n - 1) == 0 else 1024 - n)


def test_packing_spreads_long_and_repeated_documents(spark):
    """Whole pieces of one document and copies of one row lie in many groups, and two runs agree."""
    rows = [(1, "word " * 300_000)] + [(None, "the same row")] * 3000 + [(5, f"short {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, again = (pack(d, public_tokenizers.path("byte_bpe_50k.json"), group=100).collect() for d in (docs.repartition(3), docs.repartition(7)))
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    for part in ([r for r in first if r["length"] == 1024], [r for r in first if r["doc_id"] is None]):
        sizes = {}
        for r in part:
            sizes[r["sequence_id"] >> 32] = sizes.get(r["sequence_id"] >> 32, 0) + 1
        assert len(sizes) > 2 and max(sizes.values()) < 200
    assert sum(r["doc_id"] is None for r in first) == 3000 and len({(r["sequence_id"], r["offset"]) for r in first}) == len(first)


def test_huffman_codes():
    rng = np.random.default_rng(7)
    for counts, limit in ((rng.integers(0, 50, 300), 12), (2 ** np.arange(30), 8), (np.array([0, 5, 0]), 16), (np.array([3, 4]), 16), (rng.zipf(1.3, 5000) % 10**6, 16)):
        lengths = huffman.code_lengths(counts.astype(np.int64), limit)
        used = lengths[counts > 0].astype(int)
        assert used.max() <= limit and (len(used) < 2 or np.isclose((0.5**used).sum(), 1))
        present = np.flatnonzero(counts)
        order, codes = huffman.canonical(lengths)
        assert (np.diff(lengths[order].astype(int)) >= 0).all()
        parts = [rng.choice(present, n).astype(np.uint32) for n in (1, 255, 256, 257, 3000)]
        coded = [huffman.encode(p, lengths, codes) for p in parts]
        assert (huffman.Decoder(lengths).decode([c[0] for c in coded], [len(p) for p in parts], [c[1] for c in coded]) == np.concatenate(parts)).all()


def test_limited_lengths_are_optimal():
    """Against all ways to give lengths to a few ids."""
    from itertools import product

    for counts in ([1, 1, 2, 3, 9], [1, 2, 4, 8, 16], [5, 5, 5, 5, 5]):
        best = min(sum(c * n for c, n in zip(counts, ns)) for ns in product(range(1, 4), repeat=5) if sum(0.5**n for n in ns) <= 1)
        assert (huffman.code_lengths(np.array(counts), 3) * np.array(counts)).sum() == best


def test_token_files(spark, messy, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    huffman.write_tokens(messy, folder, public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(huffman.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    want = _plain_ids(messy, "word_bpe_49k.json", 2)
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in rows) == sorted((repr(d), i.tobytes()) for d, i in want)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]


@pytest.mark.parametrize("kind", ["smallint", "string", "date"])
def test_token_files_with_ids_of_any_kind(spark, tmp_path, kind):
    docs = spark.range(20).select((F.expr("date_add(date '2026-01-01', int(id))") if kind == "date" else F.col("id").cast(kind)).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    folder = f"file://{tmp_path}/{kind}"
    huffman.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    found = huffman.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in docs.collect())


def test_a_whole_vocabulary():
    """All 49,000 ids occur: codes of up to 20 bits are within a hundredth of unlimited ones."""
    counts = (10**9 / np.arange(1, 49_001) ** 1.1).astype(np.int64) + 1
    size = lambda limit: (huffman.code_lengths(counts, limit) * counts).sum() / counts.sum()
    assert size(huffman.LIMIT) < 1.01 * size(40) and size(huffman.LIMIT) <= size(16)
    lengths, rng = huffman.code_lengths(counts), np.random.default_rng(15)
    ids = rng.choice(49_000, 20_000).astype(np.uint32)
    payload, at = huffman.encode(ids, lengths, huffman.canonical(lengths)[1])
    assert (huffman.Decoder(lengths).decode([payload], [len(ids)], [at]) == ids).all()


def test_language(spark):
    samples = {"a": ["abab cab dada, bad"], "b": ["xyx zzy xyz"]}
    model = language.build(samples)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdxyzé  q.") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    got, n = language.phrases(texts, model, 16)
    for j, lang in enumerate(model.langs):
        source = b"\0" + bytes(language.classes(" ".join(samples[lang]) + " ", model.alphabet))
        for i, t in enumerate(texts):
            if n[i]:
                z, count = bytes(language.classes(t, model.alphabet)), 0
                for b in range(0, len(z), 16):
                    y, at = z[b : b + 16], 0
                    while at < len(y):
                        k = 1
                        while at + k <= len(y) and y[at : at + k] in source:
                            k += 1
                        at, count = at + max(1, k - 1), count + 1
                assert got[j, i] == count
    assert language.predict(pa.array([None, "", "12 !", "abab"]), model).field("lang_pred").to_pylist() == ["und", "und", "und", "a"]


def test_every_letter_is_told_from_others():
    """Two disjoint alphabets of 200 letters each."""
    rng = random.Random(13)
    text = lambda first: "".join(chr(first + rng.randrange(200)) for _ in range(120))
    model = language.build({"a": [text(0x4E00) for _ in range(64)], "b": [text(0x5E00) for _ in range(64)]})
    for lang, first in (("a", 0x4E00), ("b", 0x5E00)):
        assert language.predict(pa.array([text(first) for _ in range(100)]), model).field("lang_pred").to_pylist() == [lang] * 100
    wide = {"x": ["".join(chr(0x4E00 + i) for i in range(90)) * 2 + "\u4e00\u4e55\u4e58"]}
    got, n = language.phrases(["\u4e54\u4e55\u4e56\u4e57\u4e55\u4e58", "\u4e00\u4e55\u4e58\u9fff"], language.build(wide))
    assert got.tolist() == [[2, 2]] and n.tolist() == [6, 4]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.with_language(docs, language.train(docs)).filter(language.held_out(docs["doc_id"])).select("lang", "lang_pred", "score").toPandas()
    assert len(told) > 200 and (told["lang"] == told["lang_pred"]).mean() > 0.97 and told["score"].between(0, 1).all()


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    known = labels.filter(toxicity.held_out(labels["doc_id"])).select("doc_id", labels["toxic"].alias("label"))
    told = toxicity.with_severity(docs, model).select("doc_id", "severity", "grade", "toxic").join(known, "doc_id").toPandas()
    bad = told["label"] == 1
    assert told[bad]["toxic"].mean() > 0.9 and told[~bad]["toxic"].mean() < 0.01
    assert told[bad]["severity"].mean() > 10 * told[~bad]["severity"].mean() and told["severity"].between(0, 2).all()


def test_ngram_join_by_brute_force(spark):
    rng = random.Random(9)
    texts = [words(rng, rng.randrange(0, 120), 5000) for _ in range(40)]
    for t in [words(rng, 200, 5000) for _ in range(3)]:  # groups of near copies, of which some are alike only in part
        for _ in range(60):
            w = t.split()
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
            texts.append(" ".join(w))
    texts += [texts[50]] * 30 + ["", "one two", "one two", "ONE  two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(texts)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i], *(group[j] for j in linked[i])]) for i in range(n)]
        if new == group:
            break
        group = new
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in join_classes(docs).collect()}
    assert sum(got[i] != (group[i], len(linked[i])) for i in range(n)) == 0
    assert 1 - (1 - 0.8 ** least_depth()) ** 20 >= 0.999
