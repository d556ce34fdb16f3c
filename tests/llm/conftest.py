import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import types as T  # noqa: E402

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Make a table of documents from (id, text[, lang[, source]])."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r))))[:4] + (None if r[1] is None else len(r[1]),) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
