import pytest

ODD = [None, "", " \n\t ", "word", "word", "one two three four five six seven", "x" * 50_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, repeated and very long texts; null and repeated ids; clashing extra columns."""
    rows = [(i, t, "en", "s", 1, i) for i, t in enumerate(ODD)] + [(None, "no id here at all", None, None, None, 7), (3, "word", "en", "s", 1, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key int")
