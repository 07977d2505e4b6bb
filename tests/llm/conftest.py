import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text) or (doc_id, text, source)."""

    def docs(*rows):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else r
            doc_id, text, source = (*r, "s")[:3]
            full.append((doc_id, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def rows():
    """A DataFrame's rows as dicts, sorted by their text."""

    def get(df):
        return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)

    return get
