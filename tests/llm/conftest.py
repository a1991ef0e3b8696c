import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that the
    operators use inside."""
    long = "Wort " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one two three four five six"), (6, "one two three four five six"),
            (7, long), (None, "null id text with several words in it"), (8, "é ß 漢字 \U0001F600 token = 'abcdef123456' x@y.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ["row", "n", "cid", "ids", "mix", "slot", "label", "score", "spans", "digest", "k", "s", "source", "lang", "n_chars", "x", "y", "shard", "ord"]
    return df.select("*", *[F.lit("z").alias(c) for c in extra])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
