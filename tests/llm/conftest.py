"""Small tables and a session for the tests of the training-data operators."""

import pytest
from pyspark.sql import types as T


@pytest.fixture()
def docs(spark):
    """Makes a documents table from {id: text}; with extra columns whose names clash."""

    def make(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
            + [T.StructField(x, T.StringType()) for x in ("row_id", "id", "key", "n", "spans", "center", "value")]
        )
        full = [(i, t, "en" if i is None or i % 2 else "de", f"src{(i or 0) % 3}", *["x"] * 7) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make
