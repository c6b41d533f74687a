import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, score string, h string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated ids and rows, columns that clash."""
    rows = [
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "fr", None),
        (5, "wörd " * 30000, "de", "a"), (6, "one two three four five six", None, None), (None, "no id here at all", "en", "b"), (7, "7", None, "b"), (7, "another seven", "fr", "b"), (8, "🙂 ", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y", "z", "w") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
