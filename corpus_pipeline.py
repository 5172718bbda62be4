"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing and packing, in this order.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet
before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmend.llm.common import null_safe, written
from driftmend.llm.exact_dedup import exact_dedup, normalised
from driftmend.llm.language import UNKNOWN, train, with_language
from driftmend.llm.mixing import mixed
from driftmend.llm.ngram_join import join_classes
from driftmend.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes what was told."""
    told = with_language(docs.select(*COLUMNS), train(docs)).filter(F.col("lang_pred") != UNKNOWN)
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; of rows that repeat each other one."""
    told = written(exact_dedup(docs), "pipeline-copies")
    keys = ["doc_id", "text_sha256"]
    gone = told.filter(~F.col("kept")).select(*keys)
    again = written(told.filter("kept").groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "pipeline-again")
    marked = docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    kept = null_safe(marked, gone.unionByName(again), keys, "left_anti")
    if not again.isEmpty():  # some rows repeat both doc_id and text
        kept = kept.unionByName(null_safe(marked, again, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest doc_id (null last), then the smallest text hash.

    Rows are told apart by doc_id, text and all else, so null or repeated doc_ids share no fate. Texts without words stay.
    """
    rest = F.to_json(F.struct("lang", "source", "n_chars"))
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"), rest.alias("rest"))
    keyed = docs.select(*COLUMNS, row.alias("_row"))
    told = written(join_classes(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id", "n_links"), "pipeline-near")
    first = F.col("_row").eqNullSafe(F.col("class_id"))
    gone = told.filter(~first).select("_row")
    again = told.filter(first & (F.col("n_links") > 0)).groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row")
    again = written(again, "pipeline-repeats")
    kept = null_safe(keyed, gone.unionByName(again), ["_row"], "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return kept
    return kept.unionByName(null_safe(keyed, again, ["_row"], "left_semi").dropDuplicates(["_row"]).select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs.select(*COLUMNS))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_duplicates", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
