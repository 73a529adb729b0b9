import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{i % 977} goes{i % 31}" for i in range(30000))
COPY = "A passage of some length that stands in several documents, word by word, so that its bytes are found again in the others. "

#: Ids, texts, languages and sources with nulls, empties, ties, repeats and a very long text.
ODD = [
    (1, None, "en", "s1"), (2, "", "en", None), (3, "   \n\t ", None, "s1"), (4, "One", "en", "s2"), (5, "two words", "en", "s2"),
    (6, "The Same Text here", "en", "s1"), (7, "the same text HERE", "en", "s1"), (8, "the same text here", None, "s1"), (8, "the same text here", None, "s1"),
    (None, "a text without an id", "en", "s1"), (None, None, None, None), (9, LONG, "en", "s1"), (10, LONG + " end", "en", "s1"), (11, "12345 ... !!! 67", "en", "s3"),
    (12, "Größe über Maß und Ärger für alle Leute hier", "de", "s3"), (13, "ΑΒΓ привет 漢字 \U0001f600", "xx", "s3"), (14, COPY * 3 + "x", "en", "s1"), (15, "y" + COPY, "en", "s1"), (16, "z" * 500, "en", "s4"),
    (17, "<|im_start|>a<|endoftext|> it's  <^|", "en", "s4"),
]
SCHEMA = "doc_id long, text string, lang string, source string, chunk string, n long, train string, label string, slot string, mix_epoch string, lettered boolean, content_sha256 string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case and columns whose names clash with those used inside."""
    rows = [(*r, "c", 1, "t", "l", "s", "e", True, "h") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
