import pytest


@pytest.fixture(scope="session", autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
