import pytest


@pytest.fixture(autouse=True)
def _released(spark):
    """Intermediate tables of a test go when it ends."""
    yield
    from sparquill.llm import common

    common.release(spark)


@pytest.fixture
def documents(spark):
    def make(texts, ids=None):
        rows = [(i, t, "x", 1) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int")

    return make
