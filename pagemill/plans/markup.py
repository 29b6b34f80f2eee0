"""Markup queries: blocks, inline runs, lists and contents of parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.blocks import block_rows, inline_rows
from pagemill.operators.blocks import page_blocks as blocks_of
from pagemill.operators.toc import toc_entries
from pagemill.sources.tables import table
from pagemill.sources.trees import element_trees

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return element_trees(table(spark, d, "pages").select("page_id", "html"), "html")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_of(_trees(spark, d), "page_id")


@query
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = block_rows(_blocks(spark, d), "page_id")
    return rows.select("page_id", "n", "id", "kind", "level", "ordered", "anchor", "text", F.size("inlines").alias("runs"), F.size("items").alias("items"), "src", "align", "font", "weight", "indent")


@query
def page_inlines(spark: SparkSession, d: str) -> DataFrame:
    return inline_rows(_blocks(spark, d), "page_id")


@query
def page_outline(spark: SparkSession, d: str) -> DataFrame:
    """Headings with their place, and the blocks and words until the next one."""
    links = F.size(F.filter("inlines", lambda p: p["href"].isNotNull()))
    rows = block_rows(_blocks(spark, d), "page_id").select("page_id", "n", "kind", F.when(F.col("kind") == "heading", F.col("text")).alias("title"), F.size(F.split("text", r"\s+")).alias("words"), links.alias("links"))
    rows = rows.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(W.partitionBy("page_id").orderBy("n")))
    return rows.groupBy("page_id", "section").agg(F.min_by("title", "n").alias("title"), F.count("*").alias("blocks"), F.sum("words").alias("words"), F.sum("links").alias("links"))


@query
def page_link_share(spark: SparkSession, d: str) -> DataFrame:
    """Link runs and list items of each page, from the page's own array of blocks: no shuffle."""
    total = lambda size: F.aggregate("blocks", F.lit(0), lambda a, b: a + size(b))
    linked = lambda runs: F.size(F.filter(runs, lambda p: p["href"].isNotNull()))
    links = total(lambda b: linked(b["inlines"]) + F.aggregate(b["items"], F.lit(0), lambda a, i: a + linked(i["inlines"])))
    return _blocks(spark, d).select("page_id", links.alias("links"), F.size("blocks").alias("blocks"), F.size(F.filter("blocks", lambda b: b["kind"] == "list")).alias("lists"), total(lambda b: F.size(b["items"])).alias("items"))


@query
def page_contents(spark: SparkSession, d: str) -> DataFrame:
    """The navigation list of each page as a table of contents. Pages don't say that theirs is one."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<nav>", '<nav type="toc">').alias("html"))
    return toc_entries(element_trees(pages, "html"), "page_id").select("page_id", "node", "parent", "depth", "preorder", "label", "href")
