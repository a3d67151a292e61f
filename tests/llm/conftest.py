import base64
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Rows that every operator must take: nulls in every column, empty, blank and long texts, ties, repeated rows.
ODD = [
    (1, "", "en", "a"), (2, None, "en", "a"), (3, "  \n\t\n ", None, None), (4, "one", "en", "b"), (5, "one", "en", "b"), (5, "one", "en", "b"),
    (6, "The same line stands here.\nAnd another one.", "en", None), (7, "the SAME line stands here.\t\nelse", "de", "b"), (None, "one", "en", "b"), (None, None, None, None),
    (8, "Größe über Straße 漢字 🙂 d'été it's 's", "de", "c"), (9, "word " * 30_000, "en", "c"), (10, "x" * 50_000, "fr", "c"), (11, "\n\n\n", "fr", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with those of operators."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.withColumn("size", F.lit("x")).withColumn("kept", F.lit(3)).withColumn("key", F.lit(1.5)).withColumn("position", F.array(F.lit(1)))


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="session")
def rank_file(tmp_path_factory):
    """A small vocabulary of byte ranks: all bytes and a few merges."""
    merges = [b"th", b"he", b"the", b" t", b" the", b"in", b"ing", b"er", b"\xc3\xa9", b"  ", b"an", b"and", b" a", b" and", b"on", b"or", b"word", b"wo", b"rd"]
    path = tmp_path_factory.mktemp("ranks") / "small.tiktoken"
    tokens = [bytes([b]) for b in range(256)] + merges
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    return str(path)
