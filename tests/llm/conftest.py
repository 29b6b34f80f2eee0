from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Columns that could clash with names used inside the operators.
CLASHES = ["id", "row", "version", "keep", "n", "h", "bucket", "score", "tokens", "kept", "probability", "words", "root", "rep", "text_", "w"]


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, clash=False):
        """texts: (doc_id, text) pairs, or texts that are numbered."""
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{k % 3}" if k % 4 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df

    return make


@pytest.fixture(scope="session")
def real(spark):
    """Some of the real tables' texts, for brute-force comparisons."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r.doc_id, r.text) for r in rows]
