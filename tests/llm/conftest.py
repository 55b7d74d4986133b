import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = " ".join(f"word{i % 977} item{i * i % 1009}" for i in range(30000))
#: (doc_id, text, lang, source, n_chars): nulls in every column, empty and very long texts, repeated rows, ties.
ODD = [
    (None, None, None, None, None),
    (None, "a text without an id " * 4, "en", "s1", 84),
    (1, "", "en", "s1", 0),
    (2, " \n\t ", "en", None, 4),
    (3, "Short text", None, "s1", 10),
    (4, LONG, "en", "s1", len(LONG)),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "The quick brown fox, größer und schöner, jumps over the lazy dog near the river bank today.", "en", "s1", 91),
    (6, "The quick brown fox, größer und schöner, jumps over the lazy dog near the river bank today.", "en", "s1", 91),
    (7, "the QUICK brown fox, größer und schöner, jumps over the lazy dog near the river bank today.", "en", "s2", 91),
    (8, "🙂 emoji and\nlines and\nlines and\n\nmore lines of text with words that go on and on", "fr", "s1", 80),
    (9, None, "en", "s1", 0),
    (10, "All Rights Reserved. Licensed under CC BY-NC 4.0. This program is free software", "en", "s2", 79),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["uid", "key", "fp", "score", "word", "label", "_row", "_salt", "n_words", "start", "features_"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, NAMES).repartition(3)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(os.path.join(folder, "documents.parquet"))


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
