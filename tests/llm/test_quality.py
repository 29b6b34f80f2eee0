from __future__ import annotations

import binascii

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm.queries import op8_quality
from pagemill.llm.quality import STATISTICS, fit, quality_scores, statistics

from odd_texts import ODD


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels)
    told = out.where("held_out").join(labels.withColumnRenamed("doc_id", "id"), "id").select("score", "predicted", "quality").toPandas()
    assert (told.predicted == told.quality).mean() > 0.985
    good, bad = told.score[told.quality == 1].to_numpy(), told.score[told.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.998


def test_odd_rows_and_no_labels(documents, spark):
    docs = documents([*enumerate(ODD), (None, "null id"), (1, "again")], clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, none).collect()
    assert len(got) == len(ODD) + 2 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    some = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (8, 1, None), (9, 0, 0), (10, None, 0), (11, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, some).collect()
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.id is not None and binascii.crc32(str(r.id).encode()) % 4 == 2)
    assert quality_scores(documents([]), some).collect() == []


def test_fit_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, len(STATISTICS)) for c in (0, 1) for _ in range(200)]
    rows = [(v.tolist(), c) for v, c in zip(x, [0] * 200 + [1] * 200)]
    df = spark.createDataFrame(rows, "x array<double>, label int").coalesce(1)
    model = fit(df, shrinkage=0.2)
    x, y = np.array(x), np.array([0] * 200 + [1] * 200)
    z = (x - x.mean(0)) / x.std(0)
    pooled = (np.cov(z[:200].T, bias=True) + np.cov(z[200:].T, bias=True)) / 2
    density = []
    for c in (0, 1):
        s = 0.8 * np.cov(z[y == c].T, bias=True) + 0.2 * pooled
        s += (0.05 * np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
        e = z - z[y == c].mean(0)
        density.append(np.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))
    got = {tuple(r.x): r.s for r in df.select("x", model.column(F.col("x")).alias("s")).collect()}
    assert np.allclose([got[tuple(v)] for v in x.tolist()], want, atol=1e-9)


def test_statistics_are_finite_for_any_text():
    for t in ODD:
        v = statistics((t or "").encode())
        assert len(v) == len(STATISTICS) and np.isfinite(v).all()
    assert F.lit(1) is not None


def brute_query(docs, labels):
    """The query's rows by numpy alone, from the text statistics on."""
    quality = {}
    for r in labels:
        quality.setdefault(r.doc_id, []).append(r.quality)
    x = np.array([statistics((r.text or "").encode()) for r in docs])
    held = np.array([r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs])
    learnt = [(v, q) for v, r, h in zip(x, docs, held) if not h for q in quality.get(r.doc_id, [])]
    rows, y = np.array([v for v, _ in learnt]), np.array([q for _, q in learnt])
    z = (rows - rows.mean(0)) / rows.std(0)
    share = [(y == c).mean() for c in (0, 1)]
    within = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = share[0] * within[0] + share[1] * within[1]
    density = []
    for c in (0, 1):
        s = 0.7 * within[c] + 0.3 * pooled
        s += (0.05 * np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
        e = (x - rows.mean(0)) / rows.std(0) - z[y == c].mean(0)
        density.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e))
    score = 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))
    return [(r.doc_id, bool(h), p, int(p >= 0.7)) for r, h, p in zip(docs, held, score)]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    want = brute_query(*(spark.read.parquet(f"{d}/{t}.parquet").collect() for t in ("documents", "labels")))
    got = {r.doc_id: r for r in op8_quality(spark, d).collect()}
    assert len(got) == len(want) and set(next(iter(got.values())).asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for doc_id, held, score, predicted in want:
        r = got[doc_id]
        assert r.held_out == held and abs(r.score - score) < 1e-9 and (r.predicted == predicted or abs(score - 0.7) < 1e-9)
