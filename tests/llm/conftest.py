import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (or (id, text) pairs), over several partitions."""

    def make(texts, sources=None):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        data = [(i, t, "en", sources[k] if sources else "web", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, DOCS).repartition(3)

    return make
