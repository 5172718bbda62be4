import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "row", "src", "missing", "place", "taken", "target", "g", "own", "k5", "name", "level", "spans", "start", "lang_pred", "score", "severity", "toxic", "fingerprint", "ids", "group", "bucket", "t", "blocks", "_p", "_i", "copies"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and copies of one text under many ids."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 300)) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "de"]), f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0", len(base[0])) for i in range(12)]
    rows += [(200, None, "en", "s1", None), (201, "", "en", "s1", 0), (202, "   \n\t ", None, None, 6), (None, base[1], "en", "s2", 5), (None, None, None, None, None), (203, "ÄÖ ẞß 日本語 😀 İ", "de", "s3", 12)]
    rows += [(204, words(rng, 40_000), "en", "s0", 1), (205, base[2].upper(), "en", "s1", 3), (206, "x", "en", "s1", 1)]
    rows += [rows[3], rows[3], (3, base[4], "de", "s9", 2)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def crowded(messy):
    """The same with further columns whose names the operators might use themselves."""
    return messy.select("*", *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


def key(rows):
    return sorted(map(repr, rows))
