import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) rows, with further columns of clashing names."""

    def make(rows, parts=3):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
            + [T.StructField(c, T.StringType()) for c in ("id", "key", "part", "bucket", "length", "fingerprint", "piece", "digest", "row", "share", "node")]
        )
        return spark.createDataFrame([(d, t, *"abcdefghijk") for d, t in rows], schema).repartition(parts)

    return make
