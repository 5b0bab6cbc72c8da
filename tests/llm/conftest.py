import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return FOLDER


@pytest.fixture
def odd_documents(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, and clashing extra columns."""
    long_text = " ".join(f"w{i % 700} {i}" for i in range(30_000))
    data = [(1, "Same Text here", "en", "a", 14), (2, "same text HERE", "en", "a", 14), (2, "same text HERE", "en", "a", 14),
            (None, None, None, None, None), (None, "", None, "b", 0), (3, "", "en", "b", 0), (4, long_text, "en", "a", 1),
            (5, " \t\n ", "de", None, 4), (6, long_text.upper(), "en", "b", 1), (7, "one two", "fr", "c", 7), (2, "another", "en", "c", 7),
            (8, "Ünïcode ÜBER \x0b x y", "de", "c", 9), (9, "</s> <|endoftext|> it's", "en", "c", 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in ("id", "row", "digest", "size", "own_id", "key", "group", "count", "start")})


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
