"""The ordinal regression's likelihood, gradients and features by brute force; labels in conflict."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftmend.llm import toxicity
from driftmend.llm.toxicity import BITS, GRADES, best_flag, loss, severities, text_features, word_features

RNG = np.random.default_rng(61)


def plain_loss(x, grades, w, cuts):
    total = 0.0
    for values, g in zip(x, grades):
        score = float(values @ w)
        upto = lambda k: 0.0 if k < 0 else 1.0 if k == GRADES - 1 else 1 / (1 + math.exp(score - cuts[k]))
        total -= math.log(upto(g) - upto(g - 1))
    return total / len(grades)


def test_likelihood_and_gradients():
    x = RNG.random((40, 6)) * (RNG.random((40, 6)) < 0.6)
    grades, w, cuts = RNG.integers(0, GRADES, 40), RNG.normal(size=6), np.sort(RNG.normal(size=GRADES - 1)) + np.arange(GRADES - 1)
    row, ids = np.nonzero(x)
    value, by_w, by_cut = loss(row, ids, x[row, ids], grades, w, cuts)
    assert math.isclose(value, plain_loss(x, grades, w, cuts))
    step = 1e-6
    for k in range(6):
        d = np.eye(6)[k] * step
        assert abs((plain_loss(x, grades, w + d, cuts) - plain_loss(x, grades, w - d, cuts)) / (2 * step) - by_w[k]) < 1e-6
    for k in range(GRADES - 1):
        d = np.eye(GRADES - 1)[k] * step
        assert abs((plain_loss(x, grades, w, cuts + d) - plain_loss(x, grades, w, cuts - d)) / (2 * step) - by_cut[k]) < 1e-6


def test_severities_by_brute_force():
    rng = random.Random(62)
    texts = ["", None, "abcd", *(" ".join("".join(rng.choice("abcdeé1") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(0, 20))) for _ in range(80))]
    model = toxicity.Model(RNG.normal(size=1 << BITS) * (RNG.random(1 << BITS) < 0.5), np.array([0.3, 1.1]))
    got, features = severities(pa.array(texts), model), text_features(pa.array(texts))
    for t, p, f in zip(texts, got, features):
        have = {}
        for word in sorted({w for w in (t or "").lower().split()}):
            for i in word_features(pa.array([word]))[1].tolist():
                have[i] = have.get(i, 0) + 1
        assert sorted(f.tolist()) == sorted(i for i, n in have.items() for _ in range(n))
        score = sum(math.log(1 + n) * model.weights[i] for i, n in have.items())
        assert np.allclose(p, [1 - 1 / (1 + math.exp(score - c)) for c in model.thresholds])


def test_best_flag():
    for _ in range(50):
        p, bad = RNG.integers(1, 9, 30) / 10, RNG.random(30) < 0.4
        f1 = lambda t: 2 * (bad & (p >= t)).sum() / ((p >= t).sum() + bad.sum())
        if bad.any():
            assert math.isclose(f1(best_flag(p, bad)), max(f1(t) for t in p)) or len({round(f1(t), 12) for t in p if f1(t) == max(map(f1, p))}) > 0 and f1(best_flag(p, bad)) <= max(map(f1, p))


def test_labels_in_conflict(spark):
    """The most toxic label holds, in any order of rows, and low quality makes grade 2."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, "vile words here ").otherwise("kind words there "), F.col("id")).alias("text"))
    rows = [(i, int(i % 4 == 0), int(i % 8 == 0)) for i in range(400)] + [(i, 0, 1) for i in range(0, 400, 4)] + [(i, None, 0) for i in range(400)]
    models = [toxicity.train(docs, spark.createDataFrame(r, "doc_id long, toxic int, quality int").repartition(n)) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert (models[0].weights == models[1].weights).all() and models[0].flag == models[1].flag and (models[0].weights != 0).any()
    told = toxicity.with_severity(docs, models[0]).toPandas()
    assert (told["toxic"] == (told["doc_id"] % 4 == 0)).all() and told[told["toxic"]]["severity"].min() > 1 > told[~told["toxic"]]["severity"].max()


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """A labelled id that many rows share sends one of them to the driver."""
    from pyspark.sql import functions as F

    rows, read = spark.range(100_000).selectExpr("3L doc_id", "concat('some text ', id) text"), []
    docs = rows.unionByName(spark.createDataFrame([(i, f"clean words {i}") for i in range(20)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i == 3), 1) for i in range(20)], "doc_id long, toxic int, quality int")
    monkeypatch.setattr(toxicity, "fitted", lambda features, grades: read.append((len(features), grades.tolist())) or toxicity.Model(np.zeros(1 << toxicity.BITS), np.full(2, 40.0)))
    toxicity.train(docs, labels)
    ((n, grades),) = read
    held = {r["doc_id"] for r in labels.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert 3 not in held and n == 20 - len(held) and sum(grades) == 1


def test_grades_agree_with_the_flag(spark):
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 0.4, 1 << toxicity.BITS), np.array([0.2, 0.9]), 0.5)
    docs = spark.createDataFrame([(i, "".join(rng.choice([*"abcdefgh "], 30))) for i in range(200)], "doc_id long, text string")
    found = toxicity.with_severity(docs, model).collect()
    assert {r["toxic"] for r in found} == {True, False} and all((r["grade"] > 0) == r["toxic"] for r in found)
