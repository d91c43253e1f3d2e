import pytest
from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strong coffee near the old stone bridge at dawn and sing"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns that operators use inside."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, PROSE, "en", "a", len(PROSE)),
        (1, PROSE, "en", "a", len(PROSE)),
        (1, PROSE + " once more", "en", None, None),
        (None, PROSE, None, "b", 3),
        (None, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", "a", 3),
        (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)),
        (6, "x" * 100_000, "en", "b", 100_000),
        (7, "Ünï çødé 😀 " * 40, "fr", "ß", 480),
        (8, "one two", "en", "c", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("n_words", "fp", "node", "kept", "spans", "score", "bucket", "size", "start", "hash", "__x", "least", "key", "value")
    return df.withColumns({c: F.lit(f"own {c}") for c in clashing})


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def as_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))
