from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from pagemill.llm.components import components
from pagemill.llm.near_dups import near_duplicates, shingles, superminhash

from odd_texts import ODD

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(docs, size):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(docs, size, share):
    sets, parent = sets_of(docs, size), {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and share[1] * common >= share[0] * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def family(rng, n, words=120):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            k = rng.randrange(len(w))
            w[k] = f"v{rng.randrange(400)}" if rng.random() < 0.7 else w[(k + 1) % len(w)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,share", [(3, (85, 100)), (5, (80, 100))])
def test_against_brute_force(documents, real, size, share):
    rng = random.Random(size)
    texts = [t for _, t in real] + family(rng, 60) + family(rng, 30, 40) + ["Exact  copy of\ta text"] * 20 + ["exact copy OF a text"]
    docs = list(enumerate(texts))
    got = near_duplicates(documents(docs), words=size, share=share).collect()
    assert sorted(map(tuple, got)) == brute(docs, size, share)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(documents, clash):
    docs = list(enumerate(ODD))
    got = near_duplicates(documents([*docs, (None, "x y z"), (0, None), (None, None)], clash), words=3, share=(85, 100)).collect()
    assert sorted(tuple(r) for r in got if r.id is not None) == brute(docs, 3, (85, 100))
    assert sorted((tuple(r) for r in got if r.id is None), key=str) == [(None, 0, None, True), (None, 1, None, True)]


def test_empty_table(documents):
    assert near_duplicates(documents([])).collect() == []


def test_superminhash_estimates_jaccard_with_early_stopping():
    rng = np.random.default_rng(1)
    for shared, own in ((900, 100), (50, 50), (10, 5)):
        close = []
        for _ in range(20):
            x = rng.integers(0, 2**63, shared + 2 * own).astype(np.uint64)
            a, b = superminhash(x[: shared + own], 112), superminhash(np.concatenate([x[:shared], x[shared + own :]]), 112)
            close.append((a == b).mean())
        assert abs(np.mean(close) - shared / (shared + 2 * own)) < 0.04
    assert np.isfinite(superminhash(np.array([7], np.uint64), 112)).all()
    assert shingles(b"", 3).size == 0 and shingles(b"a b", 3).size == 1


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links[:-1]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in list(parent) if root(x) != x}
