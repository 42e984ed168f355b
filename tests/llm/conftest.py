import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) rows, with extra columns whose names the operators use themselves."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("id", "node", "key", "size", "comp", "text_key", "kept", "shard", "h", "w", "_id", "_gone", "score", "ids"):
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make
