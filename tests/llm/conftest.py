import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like results."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 5), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 5), (2, None, None, None, None),
        (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1), (3, "", "en", "a", 0), (4, LONG, "fr", None, 9), (5, " \t\n ", "de", "", 3), (6, "one", "de", "ü", 3), (None, None, None, None, None), (7, "mail a.b@c.de and +1 (555) 555-1234 \u0001 x", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in ("score", "shard", "slot", "size", "fp", "label", "target", "c", "found", "text_crc32", "source_size")}).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
