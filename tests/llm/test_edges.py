"""Every operator and pipeline stage on messy rows, on clashing columns, and on no rows."""

import public_tokenizers
import pytest

import corpus_pipeline
from driftmend.llm import chat, toxicity
from driftmend.llm.exact_dedup import exact_dedup
from driftmend.llm.fingerprints import edit_likeness, fingerprint
from driftmend.llm.huffman import read_tokens, write_tokens
from driftmend.llm.language import train, with_language
from driftmend.llm.mixing import mix_plan, mixed
from driftmend.llm.ngram_join import join_classes
from driftmend.llm.packing import pack
from driftmend.llm.secrets import digest, find_secrets

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def severity(docs):
    labels = docs.sparkSession.createDataFrame([(1, None), (2, 0), (3, 1), (4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    return toxicity.with_severity(docs, toxicity.train(docs, labels)).select("doc_id", "severity", "grade", "toxic")


def tokens(docs, folder=[0]):
    from driftmend.llm.common import shared_dir

    folder[0] += 1
    path = f"{shared_dir(docs.sparkSession)}/edge-{folder[0]}-{id(docs)}"
    write_tokens(docs, path, WORD)
    return read_tokens(docs.sparkSession, path)


OPERATORS = {
    "secrets": lambda d: digest(find_secrets(d)),
    "packing": lambda d: pack(d, BYTE, group=8).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "mixing": mix_plan,
    "mixed": lambda d: mixed(d).select("doc_id", "text"),
    "join": join_classes,
    "dedup": exact_dedup,
    "severity": severity,
    "fingerprint": lambda d: fingerprint(d).select("doc_id", "fingerprint"),
    "edits": edit_likeness,
    "tokens": tokens,
    "language": lambda d: with_language(d, train(d)).select("doc_id", "lang_pred", "score"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_messy(messy, crowded, nothing, name):
    run = OPERATORS[name]
    got = sorted(map(repr, run(messy).collect()))
    assert got == sorted(map(repr, run(crowded).collect()))
    assert run(nothing).collect() == []
    if name not in ("packing", "mixed"):
        assert len(got) == messy.count()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, messy, crowded, nothing, name, stage):
    found, more = stage(spark, messy, ""), stage(spark, crowded, "")
    same = [c for c in found.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(repr, found.select(same).collect())) == sorted(map(repr, more.select(same).collect()))
    assert stage(spark, nothing, "").count() == 0
    if name != "packing":
        assert found.columns == corpus_pipeline.COLUMNS
    if name == "exact_dedup":
        assert found.count() == messy.selectExpr("coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')").distinct().count()


def test_chat(spark):
    rows = [(1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, None, None, None), (None, 3, "USER ", ""), (None, None, "tool", "x" * 100_000), (2, 5, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.repair(turns).orderBy("conv_id", "position").collect()
    assert len(found) == 6 and [r["position"] for r in found] == [0, 1, 0, 1, 2, 0]
    assert [r["new_role"] for r in found[2:5]] in (["user", "assistant", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"])
    assert chat.repair(turns.limit(0)).count() == 0


def test_names_with_dots(messy):
    found = mixed(messy.withColumnRenamed("lang", "la.ng"))
    assert found.columns == ["doc_id", "text", "la.ng", "source", "n_chars"] and found.count() == mixed(messy).count()
