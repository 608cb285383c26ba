import datetime as dt  # noqa: F401

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """A maker of documents tables: (doc_id, text, lang, source) rows."""
    def make(rows):
        full = [(r + (None, None))[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(
            [(i, t, la, so, None if t is None else len(t)) for i, t, la, so in full], DOCS)
    return make
