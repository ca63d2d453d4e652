import pytest

LONG = ("word another thing, " * 30_000).strip()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "plain text with some words in it " * 10, "en", "s"),
        (1, "plain text with some words in it " * 10, "en", "s"),
        (2, None, None, None),
        (None, "a text without an id " * 10, "en", None),
        (None, None, None, None),
        (3, "", "de", "s"),
        (4, " \t\n\x0b ", "de", "s"),
        (5, LONG, "en", "t"),
        (6, "one", "en", "t"),
        (7, "One", "en", "t"),
        (8, "日本語 é\U0001f600 \x00 x", "ja", "t"),
    ]
    extra = {"row": 1, "key": 2, "low": 3, "ids": 4, "n_words": 5, "size": 6, "shard": 7, "score": 8, "spans": 9, "n_tokens": 10, "_row": 11, "_quality_n_words": 12}
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in extra)
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], schema)
