import pytest


@pytest.fixture
def docs(spark):
    """A small table with nulls, empty and odd texts, repeated rows and clashing extra columns."""
    rows = [
        (0, "The the quick fox. It's 12 o'clock, isn't it?\nA line.", "en", "a", 1),
        (1, "The the quick fox. It's 12 o'clock, isn't it?\nA line.", "en", "a", 2),
        (2, None, None, None, 3),
        (3, "", "en", "b", 4),
        (4, "  leading\t\ttabs \n\n\x1c x y 　z  end  ", "en", "b", 5),
        (5, "naïve café 漢字 🙂👩‍👩‍👧 é Σίσυφος ΣΑΣ <|endoftext|>", "fr", "b", 6),
        (6, "word " * 5000, "en", "a", 7),
        (6, "word " * 5000, "en", "a", 7),
        (None, "no id here", "en", None, 8),
        (7, "x" * 30000, "en", "a", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
