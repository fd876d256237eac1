import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""
    def make(rows):
        full = [(*r, None, None)[:4] if len(r) < 4 else r[:4] for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCUMENTS)
    return make


@pytest.fixture
def as_folder(tmp_path):
    """Write tables to a data folder that a query can read."""
    def write(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
