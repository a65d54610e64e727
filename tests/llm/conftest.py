import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from roadpulse.session import ship

    ship(spark)


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns whose names clash."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, "A plain text of a few words, nothing more.", "en", "a", 42),
        (1, "A plain text of a few words, nothing more.", "en", "a", 42),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\r\n\x0b\x0c ", "en", None, 7),
        (None, "No id here, but words all the same.", "en", None, 10),
        (None, None, None, None, None),
        (5, long, "en", "b", len(long)),
        (6, "x" * 200_000, "en", "b", 200_000),
        (7, "1" * 50_000 + " " + "a" * 50_000, "en", "c", 100_001),
        (8, "é" * 40 + "\U0001f600 \u00a0 mail me: \U0001f600a.b@c.de, now", "fr", "c", 60),
        (-9, "A plain text of a few words, nothing more.", "en", "a", 42),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "fp", "kept", "_row", "_keep", "_id", "_flag", "size", "component_id", "spans", "kind", "start", "end", "items", "_text", "a", "b"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (5, 0, 1), (6, 1, 1), (6, 0, 0), (7, None, None), (None, 1, 1), (99, 1, 1), (8, 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
