from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from pagemill.llm.vector_codes import Nearest, ball_tree, exact, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, id string, code string, error string, v string"


def brute(rows, parts=4, rounds=4, entries=256):
    """Plain full scans over Python's integers."""
    usable = [(i, [math.floor(1024 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    usable.sort(key=order)
    if not usable:
        return []
    length = len(usable[0][1])
    size = -(-length // parts)
    cut = lambda v: [(v + [0] * (size * parts - length))[p * size : (p + 1) * size] for p in range(parts)]
    fitting = [cut(v) for _, v, _ in usable if len(v) == length]
    books = [[list(v[p]) for v in fitting[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for v in fitting:
            for p in range(parts):
                groups[p].setdefault(nearest(p, v[p])[1], []).append(v[p])
        for p in range(parts):
            for e, own in groups[p].items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], {}
    for i, v, label in usable:
        found = [nearest(p, x) for p, x in enumerate(cut(v))] if len(v) == length else None
        error = min(2**63 - 1, sum(d for d, _ in found)) if found else None
        out.append((i, found and "".join(f"{e:02x}" for _, e in found), error, label))
        if found:
            sums[label] = min(2**63 - 1, sums.get(label, 0) + error)
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, sums.get(label), sha) for i, code, error, label in out), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, e, label, "a", "b", "c", "d") for i, e, label in rows], SCHEMA)
    return sorted(map(tuple, vector_codes(df).drop("label").collect()), key=repr)


@pytest.mark.parametrize("count, dim", [(300, 8), (40, 6), (290, 3)])
def test_against_full_scans(spark, count, dim):
    rng = np.random.default_rng(dim)
    rows = [(i * 3, (rng.normal(size=dim) * 0.02).tolist(), f"l{i % 3}" if i % 4 else None) for i in range(count)]
    rows += [(5000 + i, rows[7][1], "l0") for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(4, [1.0, 2.0, 3.0, 4.0], "a"), (4, [1.0, 2.0, 3.0, 4.0], "a"), (2, None, "a"), (1, [1.0, None, 1.0, 1.0], "a"), (0, [float("nan")] * 4, "a"), (3, [float("-inf")] * 4, None)]
    rows += [(9, [0.5, -0.5, 0.25, 1.0], None), (8, [1.0], None), (7, [], "b"), (None, [-1.0, -2.0, 0.0, 0.0], "b"), (None, [-1.0, -2.0, 0.0, 0.0], "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    empty_first = [(0, [], "a"), (1, [1.0], "a"), (2, [], None)]
    assert run(spark, empty_first) == brute(empty_first)


def test_large_values_stay_exact(spark):
    rows = [(i, [2.0**18 + i, -(2.0**19) * i, 1e6, 3.0 * i], "a") for i in range(20)]
    assert run(spark, rows) == brute(rows)
    codes = run(spark, [(0, [1e300, 1.0, 1.0, 1.0], "a"), (1, [-1e300, 1.0, 1.0, 1.0], "a"), (2, [1e15, 1.0, 1.0, 1.0], "a")])
    assert [c[1] for c in codes] == ["00000000", "01000000", "02000000"] and all(c[2] == 0 for c in codes)


@pytest.mark.parametrize("scale", [2, 1000, 10**8])
def test_tree_search_is_exact_and_prunes(scale):
    rng = np.random.default_rng(scale)
    book = rng.integers(-scale, scale + 1, size=(256, 3)).astype(object)  # at scale 2 many entries tie
    x = exact(rng.integers(-scale, scale + 1, size=(500, 3)).astype(object))
    find = Nearest(book.tolist(), ball_tree(book))
    best, at = find(x)
    for row, d, i in zip(x.tolist(), best.tolist(), at.tolist()):
        assert min((sum((int(a) - b) ** 2 for a, b in zip(row, e)), k) for k, e in enumerate(book.tolist())) == (int(d), i)
    assert scale == 2 or find.visited < 0.4 * 500 * 32
