import pytest


@pytest.fixture(scope="session")
def make(spark):
    return spark.createDataFrame
