import pytest


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang) as a table with more columns, some called like those that operators add."""

    def make(found):
        full = [(d, t, lang, "kept", 1) for d, t, lang in found]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, kept string, shard int").repartition(3)

    return make
