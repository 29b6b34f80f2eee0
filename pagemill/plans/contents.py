"""Contents queries: a region's book has nations as parts and suppliers as sections.

An entry's address is its nation's file, with the supplier as anchor. Chapters exist for
the files of all nations but every fifth, with a leading one in every second file, and
for suppliers with a positive balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.toc import anchors_by_path, deepest_match, first_entries, first_match, label_at, path_to_match, resolved_hrefs, without_dead
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_TOC = """WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier),
e AS (SELECT n_regionkey AS book, n_nationkey + 1 AS node, NULL::BIGINT AS parent, 0 AS depth, n_nationkey * 1000000 AS preorder, [n_nationkey + 1] AS ids, n_name AS label, 'n' || n_nationkey || '.xhtml' AS path, NULL::VARCHAR AS anchor FROM nation
    UNION ALL SELECT n_regionkey, s_suppkey + 1000, n_nationkey + 1, 1, n_nationkey * 1000000 + place, [n_nationkey + 1, s_suppkey + 1000], 'Part ' || (s_suppkey % 7), 'n' || n_nationkey || '.xhtml', 's' || s_suppkey FROM s JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT n_regionkey AS book, n_nationkey * 1000000 AS idx, 'n' || n_nationkey || '.xhtml' AS path, NULL::VARCHAR AS anchor, 'c' || n_nationkey AS chapter FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0
    UNION ALL SELECT n_regionkey, n_nationkey * 1000000 + place, 'n' || n_nationkey || '.xhtml', 's' || s_suppkey, 'c' || n_nationkey || '-' || s_suppkey FROM s JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 5 <> 4 AND s_acctbal > 0),
r AS (SELECT e.book, e.node, e.parent, e.preorder, e.label, arg_min(c.chapter, (CASE WHEN e.anchor IS NOT DISTINCT FROM c.anchor THEN 0 WHEN c.anchor IS NULL THEN 1 ELSE 2 END, c.idx)) AS chapter FROM e LEFT JOIN c ON c.book = e.book AND c.path = e.path GROUP BY ALL)"""


def _toc(spark: SparkSession, d: str) -> DataFrame:
    n, s = _parts(spark, d)
    file = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".xhtml"))
    key, part = (F.col("s_suppkey") + 1000).cast("long"), (F.col("n_nationkey") + 1).cast("long")
    tops = n.select(F.col("n_regionkey").alias("book"), part.alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), (F.col("n_nationkey") * 1_000_000).cast("long").alias("preorder"), F.array(part).alias("ids"), F.col("n_name").alias("label"), file.alias("path"), F.lit(None).cast("string").alias("anchor"))
    rows = s.select(F.col("n_regionkey").alias("book"), key.alias("node"), part.alias("parent"), F.lit(1).alias("depth"), (F.col("n_nationkey") * 1_000_000 + F.col("place")).cast("long").alias("preorder"), F.array(part, key).alias("ids"), F.concat(F.lit("Part "), (F.col("s_suppkey") % 7).cast("string")).alias("label"), file.alias("path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("anchor"))
    return tops.unionByName(rows)


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    place = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", place.alias("place"))
    return n, s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    n, s = _parts(spark, d)
    nation = F.col("n_nationkey").cast("string")
    file = F.concat(F.lit("n"), nation, F.lit(".xhtml"))
    leading = n.where("n_nationkey % 5 <> 4 and n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("book"), (F.col("n_nationkey") * 1_000_000).cast("long").alias("idx"), file.alias("path"), F.lit(None).cast("string").alias("anchor"), F.concat(F.lit("c"), nation).alias("chapter"))
    split = s.where("n_nationkey % 5 <> 4 and s_acctbal > 0").select(F.col("n_regionkey").alias("book"), (F.col("n_nationkey") * 1_000_000 + F.col("place")).cast("long").alias("idx"), file.alias("path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("anchor"), F.concat(F.lit("c"), nation, F.lit("-"), F.col("s_suppkey").cast("string")).alias("chapter"))
    return leading.unionByName(split)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolved_hrefs(_toc(spark, d), _chapters(spark, d))


@query(_TOC + " SELECT book, node, chapter FROM r")
def toc_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Each entry's chapter: that of its exact anchor, else the file's leading one, else the file's first."""
    return _resolved(spark, d).select("book", "node", "chapter")


@query(_TOC + " SELECT book, node, parent, label FROM r WHERE chapter IS NOT NULL OR node IN (SELECT parent FROM r WHERE chapter IS NOT NULL)")
def toc_kept(spark: SparkSession, d: str) -> DataFrame:
    """Entries that lead nowhere go, unless one below them leads somewhere."""
    rows = _resolved(spark, d).withColumnRenamed("path", "file").withColumn("path", F.col("ids"))
    return without_dead(rows, ["book"], F.col("chapter").isNotNull()).select("book", "node", "parent", "label")


@query(_TOC + " SELECT c.book, c.chapter, arg_min(e.label, e.preorder) AS label FROM c LEFT JOIN e ON e.book = c.book AND e.path = c.path AND e.anchor IS NOT DISTINCT FROM c.anchor GROUP BY ALL")
def toc_label_at(spark: SparkSession, d: str) -> DataFrame:
    """The label of the entry at exactly a chapter's file and anchor."""
    return label_at(_chapters(spark, d), _toc(spark, d)).select("book", "chapter", "label")


@query(_TOC + " SELECT book, arg_min(label, preorder) AS label FROM e WHERE label IN ('Part 3', 'Part 5') GROUP BY book")
def toc_first_label(spark: SparkSession, d: str) -> DataFrame:
    return first_match(_toc(spark, d), ["book"], F.col("label").isin("Part 3", "Part 5"))


@query(_TOC + """, h AS (SELECT *, label IN ('Part 3', 'Part 5') OR label LIKE '%A' AS hit FROM e),
o AS (SELECT *, coalesce(max(CAST(hit AS INTEGER)) OVER (PARTITION BY book, parent ORDER BY preorder ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS beaten FROM h)
SELECT o.book, arg_max(o.label, (o.depth, o.preorder)) AS label FROM o LEFT JOIN o p ON p.book = o.book AND p.node = o.parent WHERE o.hit AND NOT o.beaten AND NOT coalesce(p.beaten, false) GROUP BY o.book""")
def toc_deepest_label(spark: SparkSession, d: str) -> DataFrame:
    """The label that a fold over siblings ends with, in all levels."""
    return deepest_match(_toc(spark, d), ["book"], F.col("label").isin("Part 3", "Part 5") | F.endswith("label", F.lit("A")))


@query(_TOC + " SELECT book, arg_min(ids, (CASE WHEN label = 'Part 6' AND node % 4 = 0 THEN 0 ELSE 1 END, preorder)) AS path FROM e WHERE (label = 'Part 6' AND node % 4 = 0) OR label = 'Part 2' GROUP BY book")
def toc_active_path(spark: SparkSession, d: str) -> DataFrame:
    """The ids from the top to the entry of a block, or else to the first of its chapter."""
    toc = _toc(spark, d).withColumn("path", F.col("ids"))
    return path_to_match(toc, ["book"], (F.col("label") == "Part 6") & (F.col("node") % 4 == 0), F.col("label") == "Part 2")


@query(_TOC + " SELECT book, chapter, arg_min(label, preorder) AS label, min(preorder) AS preorder, count(*) AS entries FROM r WHERE chapter IS NOT NULL GROUP BY ALL")
def toc_chapter_entries(spark: SparkSession, d: str) -> DataFrame:
    """A walk in reading order: each chapter's first entry, and how many lead to it."""
    return first_entries(_resolved(spark, d), ["book"], "chapter")


@query(_TOC + " SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS entries FROM r GROUP BY book")
def toc_chapter_count(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).groupBy("book").agg(F.count_distinct("chapter").alias("chapters"), F.count("*").alias("entries"))


@query(_TOC + " SELECT book, path, list_sort(list(DISTINCT anchor)) AS anchors FROM e WHERE anchor IS NOT NULL GROUP BY ALL")
def toc_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The anchors that the contents name in each file, where it is split to chapters."""
    toc = _toc(spark, d).withColumn("href", F.concat_ws("#", "path", F.upper("anchor")))
    return anchors_by_path(toc.select("book", "href"), ["book"])
