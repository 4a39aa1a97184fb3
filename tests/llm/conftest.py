import random

import pytest
from pyspark.sql import functions as F

WORDS = "the and of tion ereth onst ating hewh ieros leble ndor athe éaux ßung".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, and columns named like inner ones."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60)), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, prose(2, 60)), (None, prose(3, 30)), (None, None), (8, prose(4, 40)), (8, prose(4, 40)), (9, "one"), (-7, "two words"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_doc", "_text", "_row", "score", "spans", "fingerprint", "root", "target", "fold", "key", "length", "value", "label"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
