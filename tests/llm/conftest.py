import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a long text, other scripts."""
    long = "\n".join(f"Line {i} holds the word w{i * 7919 % 10007} and w{i * 104729 % 10009}, no more." for i in range(3000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, "A text without an id that says a few words, ten at least here.", None, "b", 1), (4, long, "en", "a", 1), (5, "same words in here twice over, and more of them.", "en", "b", 1), (5, "same words in here twice over, and more of them.", "en", "b", 1), (6, "一" * 500 + "二" * 500, "zh", None, 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOC)
