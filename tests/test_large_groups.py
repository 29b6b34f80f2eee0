"""Results and sizes that showed only on larger tables: ties, long groups, large batches."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle  # noqa: E402


def test_primary_file_of_equal_rank(spark, tmp_path):
    """Lines of an order that rank alike, and lines without a format."""
    names = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    rows = [(k, 5, 1, flag, status) for k, tied in enumerate(["RA", "AR", "NN", "RRA"]) for flag, status in zip(tied, "FOO")]
    rows += [(10, 1, 1, None, "O"), (11, None, 1, "A", "F"), (11, 9, 1, "R", "F"), (12, 1, 2, "N", "O"), (13, 1, 1, "A", None), (13, 2, 1, "R", "O")]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "lineitem.parquet").mkdir()
    for n, part in enumerate((tmp_path / "one").glob("part-*.parquet")):
        (tmp_path / f"lineitem.parquet/part-{n}.parquet").write_bytes(part.read_bytes())
    for name in [t for t in oracle.TABLES if t != "lineitem"]:
        (tmp_path / f"{name}.parquet").write_bytes(Path(f"/root/testdata/sf0.001/{name}.parquet").read_bytes())
    assert oracle.differences(spark, "primary_file_pick", str(tmp_path)) == "same, 8 rows"


def test_hrefs_of_a_file_with_many_chapters(spark):
    """An entry meets its file's chapters without a row for each pair: 20,000 entries and chapters would make 400 million."""
    from pagemill.operators.toc import resolved_hrefs

    entries = spark.range(20_000).select(F.lit(1).alias("book"), "id", F.lit("a.html").alias("path"), F.concat(F.lit("x"), "id").alias("anchor"))
    chapters = entries.select("book", F.col("id").alias("idx"), "path", F.when(F.col("id") != 7, F.concat(F.lit("x"), (F.col("id") * 2).cast("string"))).alias("anchor"), F.concat(F.lit("c"), "id").alias("chapter"))
    met = resolved_hrefs(entries, chapters)
    assert largest_join(met) == 20_000
    assert {r.id: r.chapter for r in met.collect()} == {i: f"c{i // 2}" if i % 2 == 0 and i != 14 else "c7" for i in range(20_000)}


def largest_join(df) -> int:
    """The rows of the join in the executed plan that gave out most."""
    df.collect()
    stack, most = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name.endswith("JoinExec"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return most


def test_trees_of_a_large_batch(monkeypatch):
    """Of a batch of any size a task holds the trees of few pages at a time; each page has its nodes, in order."""
    import pyarrow as pa

    from pagemill.sources import trees

    monkeypatch.setattr(trees, "BATCH_BYTES", 20_000)
    pages = [None, "", "<p>é</p>" * 10_000] + [f"<p>{i}</p>" + "<b>x</b>" * 100 for i in range(300)]
    parts = list(trees.trees(iter([pa.array(pages), pa.array(pages[:0], pa.string()), pa.array(["<p>last</p>"])])))
    nodes = [p for part in parts for p in part.to_pylist()]
    assert [len(n) for n in nodes[:3]] == [0, 0, 20_000]
    assert [n[1]["text"] for n in nodes[3:]] == [*map(str, range(300)), "last"]
    assert max(len(part) for part in parts) <= 20_000 // 800 + 1


def test_index_shuffles_lists_not_places(spark, tmp_path):
    """What is shuffled for the index: one row for a trigram of many documents, not one for each of its documents."""
    from pagemill.operators import trigrams

    texts = [(i, f"the same words again {i % 7} \U0001f600é") for i in range(3_000)]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    rows = trigrams._partial_lists([(70_000, trigrams.gram_codes("abcab")), (65_541, trigrams.gram_codes("xabc"))]).to_pydict()
    made = {g: (b, n, trigrams.unpacked(p).tolist()) for g, b, n, p in zip(rows["gram"], rows["block"], rows["n"], rows["numbers"])}
    assert made == {"abc": (1, 2, [5, 4_464]), "bca": (1, 1, [4_464]), "cab": (1, 1, [4_464]), "xab": (1, 1, [5])}
    index = trigrams.build_index(docs, "id", "text", str(tmp_path / "i"))
    lists = {r.gram: (r.n, trigrams.unpacked(bytes(r.numbers)).tolist()) for r in index.postings.collect()}
    assert lists[" \U0001f600é"] == (3_000, list(range(3_000))) and lists["n 3"][0] == len([i for i in range(3_000) if i % 7 == 3])
    assert sorted(r.id for r in trigrams.substring_search(index, ["again 3", "N 3"]).where("query = 'n 3'").collect()) == [i for i in range(3_000) if i % 7 == 3]


def test_books_are_parsed_once(spark, tmp_path):
    """Chapters and their bodies come from the same written blocks: reading them makes no tree anew."""
    from pagemill.sources.archives import REFERS, _elements, write_epubs
    from pagemill.sources.epub import read_epubs
    from pagemill.sources.trees import tree_of

    rows = [(b, b, "en", n, f"L{n}", f"text {n}\nmore <link> {n}") for b in ("a", "b") for n in range(3)]
    write_epubs(spark.createDataFrame(rows, "book string, title string, language string, position long, label string, text string"), str(tmp_path / "books"))
    blocks = read_epubs(spark, str(tmp_path / "books"))
    assert "ArrowEvalPython" not in blocks._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.title, r.chapter_index, r.label, r.n, r.text) for r in blocks.collect())
    assert got == [(b, n, f"L{n}", k, t) for b in ("a", "b") for n in range(3) for k, t in ((1, f"text {n}"), (2, f"more <link> {n}"))]
    for markup in ("<link rel='stylesheet' href='x'>", "<p><IMG src=a>", "<svg:image\nsrc='a'/>", "<<a:img/src=x>", "<p>img</p>", "<b><a<link>", "<p/ img>"):
        assert REFERS.search(markup) or not _elements(tree_of(markup), "link", "img", "image")
    assert not REFERS.search("<p>a link to an image</p>")
