import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, source[, lang]]) as a documents table, with a column more whose name clashes."""

    def make(*rows, more="size string, key string"):
        full = [(i, t, (x + (None,) * 2)[1], (x + (None,) * 2)[0], len(t or ""), "z", "z") for i, t, *r in rows for x in [tuple(r)]]
        return spark.createDataFrame(full, f"{DOCS}, {more}")

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and blank texts, repeated rows, a repeated id, a very long text."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return docs((1, None, None), (2, "", "s"), (3, " \n\t", "s"), (None, "no id here at all", "s"), (4, "same text of some words\nand lines", "t"), (4, "same text of some words\nand lines", "t"), (5, "other", None), (5, "the id again", "t"), (6, long, "t", "en"))
