from pyspark.sql import functions as F

from driftmend.llm.language import held_out, train


def test_copies_do_not_crowd_out_a_language(spark):
    """20,000 copies of one text beside a few others, some without letters; and a language whose texts begin with digits."""
    copies = spark.range(20_000).select("id", F.lit("one sentence that a crawler met again and again").alias("text"), F.lit("x").alias("lang"))
    few = spark.range(40).select("id", F.concat(F.lit("quite other words in document "), F.col("id")).alias("text"), F.lit("x").alias("lang"))
    junk = spark.range(3_000).select("id", F.concat(F.lit("-- "), F.col("id")).alias("text"), F.lit("y").alias("lang"))
    late = spark.range(12).select("id", F.concat(F.repeat(F.lit("0"), 900), F.lit(" zzyx xyz zyx"), F.col("id")).alias("text"), F.lit("y").alias("lang"))
    docs = copies.union(few).union(junk).union(late).withColumnRenamed("id", "doc_id")
    model = train(docs)
    assert model.langs == ("x", "y")
    learned = docs.filter(~held_out(F.col("doc_id")) & F.col("text").rlike("[a-z]")).select("lang", "text").distinct().groupBy("lang").count().collect()
    for r in learned:
        assert model.sizes[model.langs.index(r["lang"])] >= 12 * r["count"]
