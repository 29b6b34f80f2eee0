"""Every op query over tables with nulls, odd and repeated rows, and over empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.llm import queries as q
from pagemill.llm.common import scratch, written

from conftest import CLASHES
from odd_texts import ODD
from test_vector_codes import brute as full_scans

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [*[(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(ODD)], (None, "null id", None, None, 7), (None, None, "de", "s0", 0), (3, "again", "en", "s0", 5), (3, "again", "en", "s0", 5)]),
    "labels": ("doc_id long, quality int, toxic int", [(0, 1, 0), (4, 0, 1), (8, 1, None), (9, 0, 0), (9, 0, 0), (10, None, 0), (None, 1, 0), (77, 1, 0)]),
    "pages": ("page_id long, url string, html string", [(1, "http://a", "<p>" + "x" * 120), (2, None, "<p>" + "x" * 120), (None, "u", "<p>" + "x" * 120), (None, None, None), (5, "u", ""), (6, "u", "small"), (6, "u", "small"), (7, "u", "long " * 60_000)]),
    "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, "user", "what is said first here"), (1, 1, "assistant", "> what is said first here\nno"), (1, 1, "assistant", "> what is said first here\nno"), (1, None, None, None), (None, 0, "user", "> what is said first here"), (2, 0, "user", "long " * 50_000)]),
    "embeddings": ("vec_id long, embedding array<float>, label int", [(0, [1.0, 0.5], 1), (50, [0.5, 0.5], 1), (50, [0.1, 0.1], 1), (51, None, 0), (52, [1.0, None], 0), (53, [float("nan"), 1.0], 0), (None, [1.0, 1.0], 0), (100, [], 0), (2, [1.0], 0), (3, [1.0, 0.5], 0)]),
}
ROWS = {"op1_warc": "pages", "op4_quotes": "conversations", "op10_top_k": None, "op11_neighbours": None, "op12_vector_codes": None}
#: What queries over vectors give, without their scores.
VECTORS = {
    "op10_top_k": [(0, 1, 3), (0, 2, 50), (0, 3, 50), (50, 1, 0), (50, 2, 3)],
    "op11_neighbours": [(0, 1, 3), (0, 2, 50), (0, 3, 50)],
    "op12_vector_codes": [(i, code) for i, code, *_ in full_scans(TABLES["embeddings"][1])],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("odd", "empty"):
        made[kind] = str(tmp_path_factory.mktemp(kind))
        for name, (schema, rows) in TABLES.items():
            df = spark.createDataFrame(rows if kind == "odd" else [], schema)
            own = {c.lower() for c in df.columns}
            df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in own]).write.parquet(f"{made[kind]}/{name}.parquet")
    return made


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_odd_and_empty_tables(spark, folders, name):
    got = q.queries()[name](spark, folders["odd"]).collect()
    source = ROWS.get(name, "documents")
    if source:
        want = len(TABLES[source][1]) - (2 if name == "op3_near_dups" else 0)  # of the three rows with id 3, op3 gives one
        assert len(got) == want
    else:
        told = [(r.vec_id, r.code) if name == "op12_vector_codes" else (r.query_id, r["rank"], r.vec_id) for r in got]
        assert sorted(told, key=repr) == sorted(VECTORS[name], key=repr)
    assert q.queries()[name](spark, folders["empty"]).collect() == []


def test_ids_of_pages_and_groups(spark, folders):
    got = q.op1_warc(spark, folders["odd"]).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (1, 2)) == [(1, "response", None), (2, "revisit", 1)]
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id is None) == [(0, "response", None), (123, "revisit", 1)]
    groups = {r.doc_id: (r.component_id, r.kept) for r in q.op3_near_dups(spark, folders["odd"]).where("doc_id is not null").collect()}
    assert groups[3] == (3, True) and all(c <= i for i, (c, _) in groups.items())


def test_scratch_removes_what_results_do_not_read(spark, tmp_path):
    import os

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    folder = base.removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark) as keep:
        written(spark.range(3).toDF("gone"), "gone")
        with scratch(spark) as keep_inner:
            inner = written(spark.range(4).toDF("inner"), "inner")
            keep_inner(inner)
        kept = written(inner.withColumn("x", F.lit(1)), "kept")
        keep(kept)
    assert kept.count() == 4
    left = {n for n in set(os.listdir(folder)) - before if n.startswith("pagemill-")}
    assert len(left) == 1 and next(iter(left)).startswith("pagemill-kept-")
