from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, in two partitions."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, source, lang = (*r, *("s", "en")[len(r) - 2 :])[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS).repartition(2)

    return make
