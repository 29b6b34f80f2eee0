from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm.fill_in_middle import DELIMITER, ESCAPE, fill_in_middle, restored

from odd_texts import ODD


def brute(doc_id, text, seed=1, rate=90, spm_rate=20):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", a, b - a
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", a, b - a


TEXTS = [*ODD, None, "", "x", "\n\r\n  \u0085", "a<P>b", "<S", "<M>", "𝒳😀é́" * 40, DELIMITER * 9, ESCAPE * 7, f"{ESCAPE}d{ESCAPE}{DELIMITER}e{ESCAPE}e{DELIMITER}" * 11, "$1\\$0 .*" * 20, "<P<S<M" * 15, "中文字符" * 2000, "long text, " * 120_000]


@pytest.mark.parametrize("more", [{}, {"seed": 5, "rate": 100, "spm_rate": 50}])
def test_against_slices(spark, documents, more):
    rows = [(i * 7 + k, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (None, None), (3, "twice"), (3, "twice")]
    got = fill_in_middle(documents(rows, clash=True), **more)
    told = got.select("row.doc_id", "row.text", "n", "form", "output", "prefix_chars", "middle_chars", restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(told) == len(rows)
    for r in told:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute(r.doc_id, r.text, **more)
        assert r.back == (r.text or "")
    assert {r.form for r in told} == {"plain", "psm", "spm"}


def test_empty_table_and_plan(spark, documents):
    out = fill_in_middle(documents([]))
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
