"""What is frequent in all parts of a table is told once for each part and length, and its text about once in all."""

from driftmend.llm import collocations as c


def test_each_length_is_counted_once(spark, monkeypatch):
    made, lean = spark.sparkContext.accumulator(0), c.frugal

    def spied(run):
        plain = lean(run)

        def counted(batches):
            for out in plain(batches):
                made.add(out.num_rows)
                yield out

        return counted

    monkeypatch.setattr(c, "frugal", spied)
    parts, phrases = 16, 50
    text = ". ".join(f"a{i} b{i} c{i} d{i}" for i in range(phrases))
    rows = [(f"row{k}. {text}", "en") for k in range(parts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "text string, lang string")
    known, totals = c.frequent_phrases(docs, 8)
    found = known.collect()
    assert len(found) == len({(r["len"], r["phrase"]) for r in found}) == phrases * (4 + 3 + 2 + 1) and {r["f"] for r in found} == {parts}
    assert [tuple(r) for r in totals.collect()] == [("en", parts * (4 * phrases + 1))]
    each = phrases * (4 + 3 + 2 + 1) + 1  # runs of a part
    assert parts * each <= made.value < 1.25 * parts * each
