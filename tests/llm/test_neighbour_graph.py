from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.neighbour_graph import nearest_neighbours, neighbour_graph, search, usable

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, node string, query string, links string"


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):  # sum() would correct for rounding
        total += x * y
    return total


def brute(rows, k, every):
    vectors = [(i, e) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    asked = {}
    for i, e in vectors:
        if i % every == 0:
            asked[i] = min(asked.get(i, e), e)
    out = []
    for q, e in asked.items():
        scored = sorted((-product(e, c), i) for i, c in vectors if i != q and len(c) == len(e))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20, every=10):
    df = spark.createDataFrame([(i, e, 0, "a", "b", "c", "d", "e") for i, e in rows], SCHEMA)
    out = nearest_neighbours(df, lambda i: i % every == 0, k=k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.5, 3)).tolist()) for i in range(1500)]  # lengths differ
    rows += [(2000 + i, rows[30][1]) for i in range(700)]  # a third are copies
    got, want = run(spark, rows), brute(rows, 20, 10)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    scores = {(q, i): s for q, _, i, s in want}
    right = [r for r in got if (r[0], r[2]) in scores]
    assert len(right) >= 0.97 * len(want) and all(scores[q, i] == s for q, _, i, s in right)
    order = [(q, -s, i) for q, _, i, s in got]
    assert order == sorted(order)


def test_separate_groups_keep_links(spark):
    """Groups smaller than k, far from one another: the rest comes from other groups (which are all as near, but for some noise)."""
    rng = np.random.default_rng(1)
    rows = [(g * 13 + m, (np.eye(9)[g] * 5 + rng.normal(size=9) * 0.01).tolist()) for g in range(9) for m in range(13)]
    got, want = run(spark, rows), brute(rows, 20, 10)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r for r in got if r[1] <= 12] == [r for r in want if r[1] <= 12]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, []), (51, []), (60, [1.0]), (61, [-3.0]), (70, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (0, [5.0, 5.0]), (3, [-1.0, 0.1]), (80, [1e200, 1e199])]
    assert run(spark, rows, k=5) == brute(rows, 5, 10)
    assert run(spark, []) == []


def test_vectors_that_are_not_in_the_graph(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(900, 8)), rng.normal(size=(12, 8))
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "id long, e array<double>")
    with neighbour_graph(df.select("id", usable(F.col("e")).alias("v")), 5) as graph:
        asked = spark.createDataFrame([(i, e.tolist(), None) for i, e in enumerate(q)], "query long, v array<double>, own long")
        ids = {r.key: r.ids[0]["id"] for r in graph.vectors.collect()}
        pools = {r.query: [ids[e.node] for e in r.pool[:5]] for r in search(graph, asked).collect()}
    found = [len(set(pools[i]) & set(np.argsort(-(x @ q[i]))[:5].tolist())) for i in range(12)]
    assert sum(found) >= 0.9 * 5 * 12
