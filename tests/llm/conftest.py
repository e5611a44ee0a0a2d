import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, and a column whose name clashes with those of operators."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "a b c d e f", "s1", "x"),
        (1, "a b c d e f", "s1", "x"),
        (2, None, "s1", None),
        (3, "", None, "y"),
        (4, " \t\n ", "s2", "y"),
        (None, "a b c d e f", "s2", "z"),
        (None, None, None, None),
        (5, long, "s3", "q"),
        (6, "A B c d\x0be f", "s3", "q"),
        (7, "▁ é 漢字 🎉\x00", "s2", "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score string")
