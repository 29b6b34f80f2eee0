from __future__ import annotations

import math

import numpy as np
import pytest

from pagemill.llm.top_k import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, v string, at string"


def brute(rows, k, every):
    vectors = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            vectors.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    asked = {}
    for i, v in vectors:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in vectors if i != q and len(c) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, e, 0, "a", "b", "c", "d") for i, e in rows], SCHEMA)
    every = more.pop("every", 10)
    out = exact_top_k(df, lambda i: i % every == 0, **more).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out)


@pytest.mark.parametrize("slices", [1, 4, 7])
def test_against_brute_force(spark, slices):
    rng = np.random.default_rng(slices)
    rows = [(i, rng.normal(size=13).tolist()) for i in range(240)]
    rows += [(300 + i, rows[3][1]) for i in range(60)]
    assert run(spark, rows, slices=slices, block=37, query_block=5) == brute(rows, 5, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, []), (51, []), (60, [1.0]), (61, [-3.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (0, [5.0, 5.0]), (3, [-1.0, 0.1])]
    assert run(spark, rows) == brute(rows, 5, 10)
    assert run(spark, []) == []


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2.0**20 + i * 1024), float(-(2.0**12)) * i]) for i in range(30)]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [3.0])]
    assert run(spark, rows) == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512)]
