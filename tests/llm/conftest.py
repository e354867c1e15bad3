import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, repeats, one very long text, and a column that clashes with names used inside."""
    long_text = " ".join(f"word{i % 977} and {i}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 10, "x"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a", 10, "y"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a", 10, "y"),
        (3, "", None, "b", 0, None),
        (4, None, "de", None, None, "z"),
        (5, " \t\n ", "fr", "b", 4, "z"),
        (None, "lonely words without an id", "en", "a", 3, "z"),
        (7, long_text, "en", "c", len(long_text), "z"),
        (8, "Ünïcödé 日本語 😀 ... !!!\nsecond line\n\nfourth", "fr", "c", 5, "z"),
        (9, "one", "en", "c", 3, "z"),
    ]
    return spark.createDataFrame(rows, f"{DOCS}, fp string")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
