from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm.line_dedup import _later_occurrences, drop_repeated_lines, keep_bitmaps

from odd_texts import ODD

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(documents, clash):
    docs = [*enumerate(ODD), (None, ODD[-1]), (3, "a repeated id line\nshared line of ten"), (90, "  SHARED line of TEN\t\nunique one here"), (3, "a repeated id line\nshared line of ten")]
    out = drop_repeated_lines(documents(docs, clash)).select("row.doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, out), key=repr) == brute(docs)


def test_real_texts_and_bitmaps(documents, real):
    out = drop_repeated_lines(documents(real)).select("row.doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, out), key=repr) == brute(real)
    for r in keep_bitmaps(documents(real)).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), bitorder="little")[: r.n_lines]
        assert r.n_lines - bits.sum() == r.n_dropped


def test_empty_table(documents):
    assert drop_repeated_lines(documents([])).collect() == []


def test_a_hash_that_fills_many_partitions(documents, spark):
    docs = [(i, f"the very same line\nown line number {i}") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = drop_repeated_lines(documents(docs)).select("row.doc_id", "text", "n_lines", "n_dropped").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, out), key=repr) == brute(docs)


def test_stream_batches_inside_one_run():
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("version", pa.int64())])
    rows = [(1, 1, 1, 0, 0), (1, 1, 1, 1, 0), (1, 1, 2, 0, 0), (1, 1, 3, 0, 0), (2, 1, 3, 1, 0), (2, 1, 5, 0, 0)]
    for size in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[k : k + size]], schema) for k in range(0, 6, size)]
        got = [tuple(r.values()) for b in _later_occurrences(iter(batches)) for r in b.to_pylist()]
        assert sorted((r[0], *r[3:5]) for r in got) == [(0, 2, 0), (0, 3, 0), (0, 5, 0), (1, 1, 0), (1, 1, 1), (2, 3, 0)]
