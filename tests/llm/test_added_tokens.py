"""Token ids against an untouched tokenizer, on texts that hold the contents of added tokens."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftmend.llm.huffman import read_tokens, write_tokens
from driftmend.llm.packing import pack
from driftmend.llm.tokens import piece_tokenizer

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", " <|endoftext|>  x", "a <|ENDOFTEXT|> b", "plain", "", None, "x <|endoftext|>\n\n y"]


def untouched(name, texts):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_ids_equal_the_untouched_library(name, spaced):
    rng = random.Random(31)
    bits = list("ab ,.\n  é日😀İ") + [" ", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "'s", "\0"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    model = piece_tokenizer(public_tokenizers.path(name), spaced)
    for _ in range(2):
        ids, at = model.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == untouched(name, texts)


def test_operators(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {i: zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for i, ids in enumerate(untouched(FILES[0][0], TEXTS))}
    assert {r["doc_id"]: r["ids_crc32"] for r in pack(docs, public_tokenizers.path(FILES[0][0])).collect()} == want
    write_tokens(docs, f"file://{tmp_path}/t", public_tokenizers.path(FILES[1][0]))
    want = {i: [*ids, 2] for i, ids in enumerate(untouched(FILES[1][0], TEXTS))}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).collect()} == want
