import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang) rows, with a column more that clashes with inner names."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None, 1, "x") for r in rows]
        return spark.createDataFrame(full, DOCS + ", n_lines int, value string").repartition(3)

    return make
