import pytest

pytest.importorskip("fumigura.llm")


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
