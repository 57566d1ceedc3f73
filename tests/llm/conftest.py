import pytest

from rastro.session import tune

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    tune(spark)

    def make(texts, ids=None, lang=None):
        rows = [(ids[i] if ids else i, t, lang[i] if lang else "en", "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
