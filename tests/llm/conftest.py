import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int, row_key string"


def rows(texts, lang="en", source="s"):
    return [(i, t, lang, source, None, True, 1, "x") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeats, ties, a long text, columns with clashing names."""
    long = "word " * 30_000 + "a" * 5000
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here now"), (5, "same text here now"), (5, "same text here now"), (None, "same text here now"), (7, long), (8, long), (9, "Same text here NOW"), (10, "x")]
    return spark.createDataFrame(rows(texts), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
