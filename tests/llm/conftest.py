import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, key string, hash long, kept boolean, label string"


def words(n, seed=1):
    """n distinct invented words, different for each seed."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    text = words(60)
    near = text.replace("w1x30", "changed")
    base = [
        (1, text, "en", "a"), (2, text, "en", "b"), (3, near, "en", "a"), (4, words(40, 2), "de", None), (5, None, None, None), (6, "", "fr", "a"),
        (7, " \n\t ", "es", "b"), (None, words(30, 3), "xx", "c"), (None, words(30, 3), "xx", "c"), (8, words(50, 4), "en", "a"), (8, words(50, 4), "en", "a"), (8, words(45, 5), "en", "a"),
        (9, "one two three", "en", "b"), (10, "same line\n" * 30, "en", "a"), (11, words(20_000, 6), "en", "a"), (12, "日本語 ünïcödé ### $$$ A-Z", "en", "é"),
        (13, words(30, 7) + " Released under the MIT License.", "en", "a"), (14, "Apache License, Version 2.0 CC BY-NC 4.0 cc by nc", "en", "a"),
    ]
    return [(i, t, la, s, None if t is None else len(t), "r", "k", 1, True, "l") for i, t, la, s in base]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
