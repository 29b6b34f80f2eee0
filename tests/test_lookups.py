"""The trigram index, clustered layouts and interval joins against plain scans; how much they read."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators.intervals import overlap_join, running_starts
from pagemill.operators.trigrams import BLOCK, _ranges, build_index, packed, substring_search, unpacked
from pagemill.sources.clustered import write_clustered

TEXTS = ["The License text", "licens e", None, "", "ab", "abc", "xABCx", "ümläut Straße ДОМ дома", "😀😀😀 smile", "line\nbreak\tab", "the license text, the license text", "aaaaaaa", "long " * 60_000 + "needle" + " hay" * 60_000]


def scanned_rows(df, column: str) -> int:
    """Rows that the scans of this column gave out."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name == "FileSourceScanExec" and f"{column}:" in node.requiredSchema().simpleString():
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return rows


def test_posting_lists_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 100, 5_000, BLOCK):
        numbers = np.sort(rng.choice(BLOCK, n, replace=False)).astype(np.int32)
        assert unpacked(packed(numbers)).tolist() == numbers.tolist()
    assert len(packed(np.arange(BLOCK, dtype=np.int32))) == BLOCK  # one byte a number where all follow one another
    assert _ranges([5], 3) == [(5, 5)] and _ranges([1, 2, 3, 50, 51, 900, 1000], 3) == [(1, 51), (900, 900), (1000, 1000)] and _ranges([1, 2, 3], 9) == [(1, 3)]


def test_search_gives_the_rows_of_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i % 9, t, "x", "y") for i, t in enumerate(TEXTS * 2)], "key long, text string, number string, query string")
    index = build_index(docs.repartition(3), "key", "text", str(tmp_path / "i"))
    queries = ["license", " LICENSE text ", "abc", "b", "", "aaa", "дом", "ß", "😀😀", "😀😀😀", "needle hay", "k\tab", "absent", "k ab", "$1.*"]
    want = sorted((q.strip().lower(), i % 9) for q in set(q.strip().lower() for q in queries) for i, t in enumerate(TEXTS * 2) if t is not None and q in t.lower())
    assert sorted(map(tuple, substring_search(index, queries).collect())) == want
    nothing = build_index(docs.limit(0), "key", "text", str(tmp_path / "none"))
    assert substring_search(nothing, ["abc", "a"]).collect() == [] and substring_search(index, []).collect() == []


def test_search_reads_few_texts(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(8)) + (" quixotic" if i in (777, 5_000) else "")) for i in range(6_000)]
    index = build_index(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", "text", str(tmp_path / "i"))
    found = substring_search(index, ["Quixotic"])
    assert sorted(r.id for r in found.collect()) == [777, 5_000]
    lists = index.postings.where(F.col("gram").isin("qui", "uix", "ixo", "xot", "oti", "tic")).count()
    assert scanned_rows(found, "text") <= 4 * 64 and lists == 6


@pytest.mark.parametrize("width", [1, 7, 50])
def test_overlap_join(spark, width):
    rng = random.Random(width)
    span = lambda most: (lambda a: (a, a + rng.choice([0, 1, 3, most])))(rng.randrange(-60, 200))
    left = [(rng.choice(["a", "b", None]), n, *span(150)) for n in range(60)] + [("a", 100, None, 5), ("a", 101, -500, 900)]
    right = [(rng.choice(["a", "b", None]), n, *span(20)) for n in range(60)] + [("a", 200, 3, None), ("b", 201, -500, 900)]
    a = spark.createDataFrame(left, "k string, l long, lo long, hi long")
    b = spark.createDataFrame(right, "k string, r long, lo2 long, hi2 long")
    got = sorted((x.l, x.r) for x in overlap_join(a, b, ["k"], ("lo", "hi"), ("lo2", "hi2"), width).collect())
    fits = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    assert got == sorted((x[1], y[1]) for x in left for y in right if fits(x, y)) and got


def test_running_starts():
    sizes = [[3, 0, 2], [], [5], [0, 0]]
    assert running_starts(pa.array(sizes, pa.list_(pa.int64()))).to_pylist() == [[0, 4, 5], [], [0], [0, 1]]
    assert running_starts(pa.array([], pa.list_(pa.int64()))).to_pylist() == []


def test_long_blocks_span_many_pages(spark, tmp_path):
    from pagemill.plans.lookups import PAGE, first_visible_block

    texts = [(1, "x" * (PAGE * 3 + 10) + "\nshort\n\nlast"), (2, ""), (3, None), (4, "\n\nonly"), (5, "a\n" * PAGE)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.page, r.first_block, r.n_blocks, r.all_begin_before) for r in first_visible_block(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 0, 1, False), (1, 1, 0, 1, True), (1, 2, 0, 1, True), (1, 3, 0, 3, False), (4, 0, 2, 1, False), (5, 0, 0, 900, False), (5, 1, 900, 900, False)]


def test_clustered_reads(spark, tmp_path):
    rows = [(u, t, f"{u}-{t}") for u in range(40) for t in range(100)] + [(7, t, "hot") for t in range(5_000)] + [(None, 3, "n"), (3, None, "n")]
    df = spark.createDataFrame(rows, "user long, at long, what string")
    table = write_clustered(df, ["user", "at"], str(tmp_path / "c"), files=16)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c/rows")).collect()), key=repr) == sorted(rows, key=repr)
    biggest = table.bounds.agg(F.max("rows")).first()[0]
    assert table.bounds.count() > 8 and biggest < 3 * len(rows) / 16  # the hot user is spread
    found = table.read(user=(30, 31), at=(5, 6))
    assert sorted(map(tuple, found.collect())) == [(u, t, f"{u}-{t}") for u in (30, 31) for t in (5, 6)]
    assert len(table.files(user=(30, 31))) <= 2 and 0 < scanned_rows(found, "what") < len(rows) / 4
    with pytest.raises(ValueError, match="not sorted"):
        table.read(what=("a", "b"))
    assert write_clustered(df.limit(0), ["user"], str(tmp_path / "e")).read(user=(1, 2)).collect() == []
