import pytest
from pyspark.sql import types as T

#: Columns of documents, and further ones whose names the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("m", "key", "h", "t", "ledger", "mix_plan", "text_key", "row_key", "a.b")]])


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text[, lang[, source]]) rows, with clashing extra columns."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
                 len(r[1]) if r[1] else 0, *["x"] * 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make
