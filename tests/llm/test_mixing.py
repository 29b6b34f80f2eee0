from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.mixing import mix, raked_cells, text_topic, word_count
from pagemill.llm.queries import MIX_MOST, MIX_ROUNDS

from odd_texts import ODD

DIMENSIONS = {"source": (F.col, 0.5), "lang": (F.col, 0.5)}


def test_margins_hold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"source": (F.col("source"), 0.5), "lang": (F.col("lang"), {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}), "topic": (text_topic("text"), 0.7)}
    cells = raked_cells(docs, targets, word_count("text"), rounds=40).toPandas()
    total = cells.tokens.sum()
    assert np.isclose(cells.weight.sum(), total) and np.isclose(cells.probability.max(), 1)
    share = cells.groupby("lang").weight.sum() / total
    assert np.allclose(share.loc[["en", "fr", "de", "es"]], [0.4, 0.3, 0.2, 0.1], atol=1e-4)
    present = cells.groupby("source").tokens.sum() ** 0.5
    assert np.allclose(cells.groupby("source").weight.sum() / total, present / present.sum(), atol=1e-4)
    assert np.allclose(cells.probability, cells.weight / cells.tokens / (cells.weight / cells.tokens).max())


def test_sampled_tokens_follow_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mix(docs, {"lang": (F.col("lang"), {"en": 1, "fr": 1, "de": 1, "es": 1})}, word_count("text")).where("kept")
    shares = out.groupBy("row.lang").agg(F.sum("tokens").alias("t")).toPandas().set_index("lang").t
    assert np.allclose(shares / shares.sum(), 0.25, atol=0.03)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(documents, clash):
    docs = documents([*enumerate(ODD), (None, "null id words"), (4, "again")], clash)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    out = mix(docs, {"source": (F.col("source"), 0.5), "lang": (F.col("lang"), {"en": 1.0, "xx": 3.0})}, word_count("text")).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        assert r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or ""))
        assert 0 <= r.probability <= 1 and (r.row.lang == "en" or r.probability == 0)
    assert mix(documents([]), {"lang": (F.col("lang"), 0.5)}, word_count("text")).collect() == []
    assert DIMENSIONS


def test_tied_margins_hold_with_production_rounds(spark):
    cells = [("a", "en", 1000), ("a", "fr", 1), ("b", "en", 1), ("b", "fr", 1000)]
    docs = spark.createDataFrame(cells, "source string, lang string, n long")
    targets = {"source": (F.col("source"), {"a": 0.5, "b": 0.5}), "lang": (F.col("lang"), {"en": 0.55, "fr": 0.45})}
    got = raked_cells(docs, targets, F.col("n"), rounds=MIX_ROUNDS).toPandas()
    assert np.allclose(got.groupby("source").weight.sum() / 2002, [0.5, 0.5], atol=1e-6)
    assert np.allclose(got.groupby("lang").weight.sum() / 2002, [0.55, 0.45], atol=1e-6)


def test_targets_that_contradict_each_other_are_reported(spark):
    docs = spark.createDataFrame([("a", "en", 10), ("b", "fr", 10)], "source string, lang string, n long")
    targets = {"source": (F.col("source"), {"a": 0.5, "b": 0.5}), "lang": (F.col("lang"), {"en": 0.8, "fr": 0.2})}
    with pytest.warns(UserWarning, match="source 'b'"):
        raked_cells(docs, targets, F.col("n"), rounds=MIX_ROUNDS)


def test_bounded_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"source": (F.col("source"), 0.7), "lang": (F.col("lang"), 0.7), "topic": (text_topic("text"), 0.8)}
    free, bound = (raked_cells(docs, targets, word_count("text"), rounds=MIX_ROUNDS, most=most).toPandas() for most in (None, MIX_MOST))
    assert (free.weight / free.tokens).max() > MIX_MOST >= (bound.weight / bound.tokens).max() - 1e-9
    assert (bound.probability * bound.tokens).sum() / bound.tokens.sum() > 0.49
    for n in targets:
        assert np.allclose(free.groupby(n).weight.sum(), bound.groupby(n).weight.sum(), rtol=1e-5)
