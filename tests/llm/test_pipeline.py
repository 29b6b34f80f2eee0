from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm.common import written

from odd_texts import ODD


def test_stages_on_real_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, d), "test")
        assert docs.count() <= before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.where(F.col("n_chars") != F.length("text")).isEmpty()
        if name == "quality":
            labels = spark.read.parquet(f"{d}/labels.parquet")
            lost = before.join(docs, "doc_id", "left_anti").join(labels, "doc_id")
            assert lost.where("quality = 1").count() <= 2
        if name == "near_dups":
            assert docs.select("text").distinct().count() >= docs.count() - 1
    assert docs.count() > 0 and docs.where("n_tokens < 2").isEmpty()


def test_odd_rows_extra_columns_and_empty_tables(documents, spark, tmp_path):
    for name in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{name}", f"{tmp_path}/{name}")
    for docs in (documents([*enumerate(ODD), (None, "null id here"), (2, "again"), (2, "again")], clash=True), documents([])):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, written(stage(spark, docs, str(tmp_path)), "test")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert docs.count() <= n


def test_near_dups_keep_one_of_each_group(documents, spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = documents([(3, text), (1, text + " more"), (2, "something else entirely here now"), (2, "something else entirely here now"), (None, text), (None, text)])
    got = corpus_pipeline.near_dups(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, text + " more"), (2, "something else entirely here now"), (None, text), (None, text)], key=repr)


def test_near_dups_judge_each_text_of_a_repeated_id(documents, spark):
    def text(k, n=200):
        return " ".join(f"w{k}x{i}" for i in range(n))

    unlike = [(7, text(k)) for k in range(30)]
    copies = [(7, text(k) + " more") for k in range(40, 50)]
    firsts = [(-3 - k, text(k)) for k in range(40, 50)]
    docs = documents([*unlike, *copies, *firsts, (7, text(0)), (9, text(1) + " more"), (12, None), (12, text(60, 3))])
    got = corpus_pipeline.near_dups(spark, docs, "").collect()
    want = [*unlike, *firsts, (12, None), (12, text(60, 3))]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    named = corpus_pipeline.near_dups(spark, docs.withColumn("doc_id", F.concat(F.lit("d"), (F.col("doc_id") + 100).cast("string"))), "")
    assert named.count() == len(want)


def test_against_brute_force(spark):
    """All stages, step by step in plain Python, against run()."""
    import numpy as np
    import sentencepiece

    from pagemill.llm.mixing import TOLERANCE
    from pagemill.llm.queries import piece_model_path
    from test_line_dedup import brute as brute_lines
    from test_near_dups import brute as brute_groups
    from test_quality import brute_query

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    told = brute_query(docs, spark.read.parquet(f"{d}/labels.parquet").collect())
    about = {r.doc_id: (r.source or "", r.lang or "") for r in docs}
    left = [(r.doc_id, r.text or "") for r, (_, _, score, _) in zip(docs, told) if score >= corpus_pipeline.QUALITY_THRESHOLD]
    left = [(i, text) for i, text, _, dropped in brute_lines(left) if not dropped or text.strip(" \t\n\x0b\x0c\r")]
    kept = {i for i, _, _, stays in brute_groups(left, 5, (80, 100)) if stays}
    left = [(i, t) for i, t in left if i in kept]

    topic = lambda t: "legal" if "license" in t.lower() else "brief" if len(t) < 1000 else "prose"
    words = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in left], float)
    cells, at = np.unique([f"{about[i][0]}|{about[i][1]}|{topic(t)}" for i, t in left], return_inverse=True)
    tokens = np.bincount(at, words)
    weight = tokens.copy()
    parts = {n: np.unique([c.split("|")[k] for c in cells], return_inverse=True)[1] for k, n in enumerate(("source", "lang", "topic"))}
    aims = {}
    for n, power in corpus_pipeline.TARGETS.items():
        raw = np.bincount(parts[n], tokens) ** power
        aims[n] = raw / raw.sum() * tokens.sum()
    for rounds in range(1, 400):
        for n in parts:
            weight = np.minimum(weight * (aims[n] / np.bincount(parts[n], weight))[parts[n]], corpus_pipeline.MOST * tokens)
        if rounds >= 15 and rounds % 5 == 0 and max(np.abs(np.bincount(parts[n], weight) / aims[n] - 1).max() for n in parts) <= TOLERANCE:
            break
    chance = weight / tokens / (weight / tokens).max()
    draw = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 2**52
    left = [(i, t, abs(draw(i) - chance[c]) < 1e-4) for (i, t), c in zip(left, at) if draw(i) < chance[c] or abs(draw(i) - chance[c]) < 1e-4]

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    want = {i: sp.encode(t, add_bos=True, add_eos=True) for i, t, _ in left}
    got = {r.doc_id: np.frombuffer(bytes(r.token_ids), "<u4").tolist() for r in corpus_pipeline.run(spark, d).collect()}
    close = {i for i, _, near in left if near}
    assert set(got) - close == set(want) - close and len(got) > 20
    assert all(got[i] == want[i] for i in got)
