import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, kept string"

LONG = " ".join(f"w{i % 977}" for i in range(20_000))
TEXTS = [
    (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \n\t ", None, None), (4, LONG, "en", "s1"), (5, LONG, "en", "s1"), (5, LONG, "en", "s1"),
    (6, "one two three four", "en", "s1"), (7, "One TWO three\tfour", "en", "s1"), (8, "é漢字 😀 a@b.org, +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "fr", "s2"),
    (None, "no id here at all for this row", None, "s2"), (9, "x" * 50_000, "de", "s2"), (10, "1" * 30_000 + "@" * 5, "de", "s2"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x") for r in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
