import pytest

#: Extra columns whose names the operators use inside.
EXTRA = ["id", "quality", "size", "key", "bucket", "component", "digest", "doc", "dk", "flag", "_flag", "_id", "at", "class", "n", "word", "h", "copies", "score", "rest", "s", "p", "m"]
LONG = "many words " * 20_000 + "end"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, "one two three", None, None, 13), (3, "one two three", None, None, 13), (4, LONG, "en", "a", len(LONG)),
        (None, "no id here", "en", "b", 10), (5, "éè \U0001f600 中文 \0 x", "fr", "b", 9), (6, " \t\n\x0b\x0c\r ", "fr", "b", 7), (7, LONG, "en", "a", len(LONG)),
    ]
    df = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))
    return df


@pytest.fixture(scope="session")
def plain(spark):
    return "doc_id long, text string, lang string, source string, n_chars long"
