import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; ids from 0, languages and sources as given or null."""

    def build(texts, langs=None):
        rows = [(i, t, langs[i] if langs else None, None, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build
