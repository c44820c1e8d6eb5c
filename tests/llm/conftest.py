import pytest

#: More columns than the operators use, with names that they use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, block string, key string, n long, of string, part int, row_ long, digest string"


def rows(texts):
    return [(i, t, lang, source, len(t or ""), 1, 2, "b", "k", 3, "o", 4, 5, "d") for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, lang, source), with extra columns."""
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def messy(make):
    """Nulls in each column, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"word{i % 977} other{i % 31}." for i in range(30_000))
    a = "The same text, with some words in it that are not so few."
    return make(
        [
            (1, a, "en", "a"), (2, a, "en", "a"), (2, a, "en", "a"), (None, a, None, None), (None, None, None, None),
            (3, None, "de", "b"), (4, "", "de", "b"), (5, " \n\t ", "de", "b"), (6, long, "en", "b"), (7, long + " end", "en", None),
            (8, "x" * 50_000, "fr", "c"), (9, "1" * 30_000, None, "c"), (10, "a@" * 5_000, "fr", "c"), (-3, "\n".join(["l1", "l2", "l3"] * 3), "fr", "c"),
        ]
    )


@pytest.fixture(scope="session")
def empty(make):
    return make([])
