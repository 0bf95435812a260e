import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def of(pairs):
        return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in pairs], DOCS)

    return of
