import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with an extra column that clashes with operators' names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], schema)

    return make


EDGES = [(1, None), (2, ""), (3, " \t\n"), (None, "no id here at all"), (4, "one"), (4, "one"), (5, "word " * 40000), (6, "naïve 日本語 text 😀 with marks"), (7, "naïve 日本語 text 😀 with marks")]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)
