import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, row string, kept_text string"
ODD = [None, "", " \t\n ", "one", "The same é ß 日本", "a b c d e f g h " * 30, "x" * 5000, "line\n\nline\nline 12\n"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 7, "r", "k") for k, t in enumerate(ODD)]
    rows += [(None, None, None, None, None, None, None, None), (None, "one", None, None, None, None, None, None), rows[5], rows[5]]
    rows += [(100, "long " * 40_000, "en", "s0", 200_000, 7, "r", "k")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
