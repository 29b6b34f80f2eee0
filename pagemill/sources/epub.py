"""Books from the documents of e-book archives: contents, chapters and blocks.

The archives are read by the data source in `archives`; what they hold is parsed by the
operators for element trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import href_anchor, href_path
from pagemill.operators.blocks import block_rows, page_blocks, with_natural_widths
from pagemill.operators.toc import anchors_by_path, label_at, toc_entries

from .archives import epub_documents
from .kept import kept
from .trees import element_trees


def resolved_path(base: Column, href: Column) -> Column:
    """A path relative to the folder of a file, without `.` and `..`, in the same archive."""
    bare = href_path(href)
    parts = F.split(F.concat(F.regexp_extract(F.lower(base), r"^(.*/)?[^/]*$", 1), bare), "/")
    kept_parts = F.filter(parts, lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p)))
    return F.when(bare == "", F.lower(base)).otherwise(F.array_join(F.aggregate(kept_parts, F.array().cast("array<string>"), up), "/"))


def epub_toc(documents: DataFrame) -> DataFrame:
    """The contents of each book: (book, node, parent, depth, preorder, path, label, href, file, anchor)."""
    named = documents.where("role = 'contents'").select(F.to_json(F.struct("book", F.col("href").alias("base"))).alias("at"), "markup")
    rows = toc_entries(element_trees(named, "markup"), "at").withColumn("of", F.from_json("at", "book string, base string"))
    rows = rows.select(F.col("of.book").alias("book"), F.col("of.base").alias("base"), *[c for c in rows.columns if c not in ("at", "of")])
    return rows.withColumns({"file": resolved_path(F.col("base"), F.col("href")), "anchor": F.lower(F.btrim(href_anchor(F.col("href"))))}).drop("base")


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a folder's books (see book_blocks). The documents are written
    once, so that each archive is opened once, whatever is read of the result."""
    return book_blocks(kept(epub_documents(spark, folder), "books"))


def book_blocks(documents: DataFrame) -> DataFrame:
    """One row for each block of each chapter; a file without chapters has one row with its status.

    A document is split to chapters where a block has an anchor that the contents name.
    A chapter's label is that of the contents at its file and anchor, else its first
    heading, else its number; labels that only repeat the book's title don't count.
    """
    about = documents.select("book", "status", "title", "authors", "language").distinct()
    toc = kept(epub_toc(documents), "contents")
    keyed = documents.where("role = 'chapter'").select(F.to_json(F.struct("book", "position", "href")).alias("page"), "images", "markup")
    blocks = block_rows(page_blocks(with_natural_widths(element_trees(keyed, "markup"), "images"), "page"), "page")
    links = F.size(F.filter("inlines", lambda p: p["href"].isNotNull()))
    blocks = blocks.withColumn("at", F.from_json("page", "book string, position int, href string")).select(F.col("at.*"), "n", "kind", "anchor", "text", links.alias("links"))
    blocks = kept(blocks, "blocks").withColumn("file", F.lower("href"))
    splits = anchors_by_path(toc.select("book", F.concat("file", F.lit("#"), "anchor").alias("href")), ["book"]).withColumnRenamed("path", "file")
    order = W.partitionBy("book").orderBy("position", "n")
    own = F.lower(F.btrim("anchor"))
    cut = blocks.join(splits, ["book", "file"], "left").withColumn("starts", F.coalesce(F.array_contains("anchors", own), F.lit(False)))
    fresh = F.when(F.lag("position").over(order).eqNullSafe(F.col("position")) & ~F.col("starts"), 0).otherwise(1)
    cut = cut.withColumn("fresh", fresh).withColumn("chapter_index", F.sum("fresh").over(order).cast("int") - 1)
    heading = F.when((F.col("kind") == "heading") & (F.col("text") != ""), F.col("text"))
    chapters = cut.groupBy("book", "chapter_index").agg(F.min("href").alias("path_"), F.min(F.when(F.col("fresh") == 1, F.when(F.col("starts"), own))).alias("anchor"), F.min_by(heading, F.when(heading.isNotNull(), F.col("n"))).alias("heading"))
    named = label_at(chapters.withColumn("path", F.lower("path_")), toc.select("book", F.col("file").alias("path"), "anchor", "label", "preorder")).join(about, "book", "right")
    same = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    fit = lambda c: F.when(~same(F.col(c)).eqNullSafe(same(F.col("title"))), F.col(c))
    number = (F.col("chapter_index") + 1).cast("string")
    slug = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    stem = F.concat(F.lit("chapter-"), number, F.lit("-"), slug(F.regexp_extract("path_", r"([^/]*?)(\.[^./]*)?$", 1)), F.coalesce(F.concat(F.lit("--"), slug(F.col("anchor"))), F.lit("")))
    named = named.select("book", "status", "title", "authors", "language", "chapter_index", F.when(F.col("chapter_index").isNotNull(), stem).alias("chapter_id"), F.col("path_").alias("href"), F.coalesce(fit("label"), fit("heading"), F.concat(F.lit("Chapter "), number)).alias("label"))
    within = F.row_number().over(W.partitionBy("book", "chapter_index").orderBy("position", "n"))
    body = cut.select("book", "chapter_index", within.alias("n"), "kind", "text", "links")
    return named.join(body, ["book", "chapter_index"], "left").withColumnRenamed("book", "path")
