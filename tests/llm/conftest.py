import random

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of ``(doc_id, text)`` rows, or ``(doc_id, text, lang)``."""

    def make(rows):
        full = [(*row, None)[:3] for row in rows]
        return spark.createDataFrame([(i, t, g, None if t is None else "src0", None if t is None else len(t)) for i, t, g in full], DOCUMENT)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose: ``prose(seed, n)`` gives ``n`` words."""
    syllables = ["an", "the", "re", "ou", "tion", "li", "bo", "ka", "mur", "é", "zü"]

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    return make
