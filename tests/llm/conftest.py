import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with the other columns null."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)

    return make
