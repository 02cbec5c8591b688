import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, kept string, id string, words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose), (2, prose), (2, prose), (3, ""), (4, None), (None, prose), (None, None), (5, "a " * 100_000), (6, "x" * 50_000), (7, prose + " tail"), (8, "é\n ü\t\x0b z"), (5, "other text of one id")]
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", "i", "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
