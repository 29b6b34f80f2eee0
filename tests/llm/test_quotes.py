from __future__ import annotations

import hashlib
import os
import random
import sys
from pathlib import Path

from pagemill.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, lines string, run string, key string, conv string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return {(r.row.conv_id, r.row.turn): r for r in link_quotes(df).collect()}


def test_nested_quotes_threads_and_order(spark):
    rows = [
        (1, 0, "user", "How do I sort a list in place?\nThanks a lot"),
        (1, 1, "assistant", "> how do I  SORT a list in place?\nCall sort on the list itself."),
        (1, 2, "user", "A question about something else"),
        (1, 3, "user", ">> How do I sort a list in place?\n> Call sort on the list itself.\nAnd in reverse order?"),
        (1, 4, "assistant", "> And in reverse order?\nPass reverse as true."),
        (2, 0, "user", "> And in reverse order?\nOther conversation"),
    ]
    got = linked(spark, rows)
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, None, 1, 3]
    assert [got[1, t].thread_turn for t in range(5)] == [0, 0, 2, 0, 0]
    assert [got[1, t].depth for t in range(5)] == [0, 1, 0, 2, 3]
    assert [got[1, t].position for t in range(5)] == [0, 1, 4, 2, 3]
    assert (got[1, 3].n_quoted, got[1, 3].n_linked) == (2, 2)
    assert got[1, 3].own_text == "And in reverse order?"
    assert got[2, 0].parent_turn is None


def test_odd_rows_and_empty_table(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", ""), (1, 2, "user", "> "), (None, 1, "user", "null conversation text"), (None, None, "user", "> null conversation text"), (3, 0, None, ">" * 5000 + " deep"), (4, 0, "user", "same message said twice"), (4, 0, "user", "same message said twice"), (4, 1, "user", "> same message said twice")]
    got = linked(spark, rows)
    assert got[4, 1].parent_turn == 0 and got[None, None].parent_turn is None and got[1, 0].own_text == ""
    assert link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_on_generated_quotes(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import oracle

    rng, rows = random.Random(3), []
    for c in range(20):
        said = []
        for t in range(rng.randint(1, 12)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.6:
                    parts += [">" * rng.randint(1, 3) + " " + x for x in rng.choice(said).split("\n")]
                parts.append(" ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "eps"]) for _ in range(rng.randint(1, 5))))
            said.append("\n".join(parts))
            rows.append((c, t, "user", said[-1]))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in os.listdir("/root/testdata/sf0.001"):
        if not name.startswith("conversations"):
            os.symlink(f"/root/testdata/sf0.001/{name}", f"{tmp_path}/{name}")
    assert oracle.differences(spark, "op4_quotes", str(tmp_path)).startswith("same")
    assert hashlib.sha256(b"").hexdigest()
