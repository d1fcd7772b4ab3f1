import pytest


@pytest.fixture
def documents(spark):
    """A table of ``(doc_id, text)`` rows."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
