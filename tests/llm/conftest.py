import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must take: nulls, empty, blank and very long texts, repeats, and columns with names that operators use themselves."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten"),
        (2, "one two three four five six seven eight nine ten"),
        (2, "one two three four five six seven eight nine ten"),
        (3, None),
        (4, ""),
        (5, " \n\t\n "),
        (6, "word"),
        (7, long),
        (8, "x" * 100_000),
        (None, "a row without an id, of several words, twice here"),
        (None, "a row without an id, of several words, twice here"),
        (None, None),
        (9, "日本語 🙂 ÀÉ straße 12 34"),
    ]
    extra = "id long, text string, lang string, source string, h1 long, block int, spans string, _id long, key string, part int, lines string, size long, k long, y double, batch int, item long, words string"
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", 1, 1, "s", 1, "k", 1, "l", 1, 1, 1.0, 1, 1, "w") for i, t in rows], "doc_id" + extra.removeprefix("id"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
