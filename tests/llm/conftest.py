import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\r ", "en", "a"),
    (4, "one", None, "a"),
    (4, "one", None, "a"),
    (5, "One two", "de", None),
    (None, "one two three", "de", "b"),
    (6, "é ß \u00a0x\u2028y\x00z 😀", "fr", "b"),
    (7, "word " * 60_000, "en", "b"),
    (8, "x" * 300_000, "en", "b"),
    (9, "A b. C d!\n\nA b. C d!\n\x85 end \x85", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    more = {c: "z" for c in ("score", "n", "x", "a", "b", "words", "size", "findings", "taken", "rep", "node", "shard", "y", "k")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in more.items()})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")
