"""The registered queries of the llm operators, and SQL for those that it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmend.llm.common import shared_dir
from driftmend.llm.collocations import collocations
from driftmend.llm.exact_dedup import LOWER, UPPER, exact_dedup
from driftmend.llm.fingerprints import edit_likeness
from driftmend.llm.huffman import read_tokens, write_tokens
from driftmend.llm import chat, licenses, toxicity
from driftmend.llm.language import held_out, train, with_language
from driftmend.llm.mixing import WORD, mix_plan
from driftmend.llm.negatives import hard_negatives, prepared
from driftmend.llm.ngram_join import join_classes
from driftmend.llm.packing import pack
from driftmend.llm.secrets import digest, find_secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s),
o AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER before, 0) AS size_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
  FROM w WINDOW before AS (ORDER BY source_size / CAST(w AS DOUBLE), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, min(CASE WHEN 3.0 * source_size * w_left <= (total - 3.0 * size_before) * w THEN 1 ELSE 0 END)
    OVER (ORDER BY source_size / CAST(w AS DOUBLE), r) AS clamped FROM o),
l AS (
  SELECT sum(source_size) - 3 * coalesce(sum(source_size) FILTER (clamped = 1), 0) AS remaining, coalesce(sum(w) FILTER (clamped = 0), 1) AS share FROM c),
t AS (
  SELECT c.source, source_size,
    CASE WHEN clamped = 1 THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(remaining AS DOUBLE) * w / CAST(share AS DOUBLE) END AS target
  FROM c, l),
q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS whole,
    CAST(floor(target + 0.5) AS BIGINT) % greatest(source_size, 1) AS rest FROM t),
x AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM x JOIN q ON x.source IS NOT DISTINCT FROM q.source
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_table(spark, sf_dir, "documents"))


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return with_language(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.with_severity(docs.select("doc_id", "text"), model).drop("text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(_table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 3
"""


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT d, lang, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS s FROM d)),
v AS (SELECT lang, d, i, generate_subscripts(w, 1) AS j, unnest(w) AS w FROM (SELECT lang, d, i, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p)),
g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM v WINDOW o AS (PARTITION BY d, i ORDER BY j)),
f AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (h.f + t.f) AS BIGINT) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f t ON t.lang = k.lang AND t.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (
  SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2)) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN u USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM x JOIN (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""


OP6_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_chat, op3_packing, op4_mixing, op5_ngram_join, op6_exact_dedup, op7_toxicity, op8_fingerprints, op9_huffman, op10_language, op11_collocations, op12_negatives, op13_licenses)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op11_collocations": OP11_SQL, "op12_negatives": OP12_SQL}
