import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text) or longer rows."""

    def make(rows, schema=DOCS):
        full = [tuple(r) + (None,) * (len(schema.split(", ")) - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
