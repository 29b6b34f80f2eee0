"""Tables of contents, flattened: (book, node, parent, depth, preorder, path, label, href).

A node's path are the numbers of the nodes from the top to itself, so that ancestors are
known without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import href_anchor, href_path


def first_match(toc: DataFrame, by: list[str], matches: Column) -> DataFrame:
    """The label of the first matching node in reading order."""
    return toc.where(matches).groupBy(*by).agg(F.min_by("label", "preorder").alias("label"))


def deepest_match(toc: DataFrame, by: list[str], matches: Column) -> DataFrame:
    """The label that a fold over siblings ends with: a node that matches itself replaces
    all found among its earlier siblings, a match below it only if it is at least as deep.

    So a match is out if it, or an ancestor of it, has a later sibling that itself
    matches; of the others the deepest wins, of equally deep ones the last.
    Columns besides `by`: node, parent (null at the top), depth, preorder, label.
    Nodes with empty labels don't match.
    """
    hit = matches & (F.coalesce(F.col("label"), F.lit("")) != "")
    rows = toc.withColumn("hit", hit)
    siblings = W.partitionBy(*by, "parent").orderBy("preorder").rowsBetween(1, W.unboundedFollowing)
    # A node is beaten if a later sibling matches; what is below a beaten node is out too.
    rows = rows.withColumn("out", F.coalesce(F.max(F.col("hit").cast("int")).over(siblings), F.lit(0)) == 1)
    most = rows.agg(F.max("depth")).first()[0] or 0
    for _ in range(most):
        above = rows.select(*by, F.col("node").alias("parent"), F.col("out").alias("up"))
        rows = rows.join(above, [*by, "parent"], "left").withColumn("out", F.col("out") | F.coalesce("up", F.lit(False))).drop("up")
    return rows.where("hit and not out").groupBy(*by).agg(F.max_by("label", F.struct("depth", "preorder")).alias("label"))


def resolved_hrefs(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """TOC entries (book, path, anchor and others) with their chapter, from chapters (book, idx, path, anchor,
    chapter): the exact anchor first, then the chapter without one, then the first of the path.

    An entry meets one row for its place and one for its file, however many chapters a file has.
    """
    named = chapters.where(F.col("chapter").isNotNull())
    exact = named.groupBy(F.col("book").alias("b"), F.col("path").alias("p"), F.col("anchor").alias("a")).agg(F.min_by("chapter", "idx").alias("exact"))
    whole = F.when(F.col("anchor").isNull(), F.col("idx"))
    files = named.groupBy(F.col("book").alias("b2"), F.col("path").alias("p2")).agg(F.coalesce(F.min_by("chapter", whole), F.min_by("chapter", "idx")).alias("loose"))
    met = toc.join(exact, (F.col("book") == F.col("b")) & (F.col("path") == F.col("p")) & F.col("anchor").eqNullSafe(F.col("a")), "left")
    met = met.join(files, (F.col("book") == F.col("b2")) & (F.col("path") == F.col("p2")), "left")
    return met.select(*toc.columns, F.coalesce("exact", "loose").alias("chapter"))


def toc_entries(trees: DataFrame, key: str) -> DataFrame:
    """Element trees of navigation documents or the older NCX to rows: (key, node, parent,
    depth, preorder, path, label, href).

    Entries are the items of the list in the first `nav` whose type names a contents
    table, or the points of a navigation map. Entries without label, address and
    any such entry below them are left out; a label falls back to the address.
    """
    node = lambda a: F.element_at("nodes", a)
    typed = lambda x: F.exists(F.map_entries(x["attrs"]), lambda e: F.endswith(e["key"], F.lit("type")) & F.contains(e["value"], F.lit("toc")))
    roots = F.filter("nodes", lambda x: ((x["tag"] == "nav") & typed(x)) | (x["tag"] == "navmap"))
    rows = trees.select(key, "nodes", F.get(roots, 0).alias("root")).where(F.col("root").isNotNull())
    inside = lambda x: F.slice("nodes", x["n"], x["last"] - x["n"] + 1)
    listed = lambda x: F.forall(x["path"], lambda a: (a <= F.col("root.n")) | node(a)["tag"].isin("ol", "ul", "li", "navpoint"))
    items = F.filter(F.slice("nodes", F.col("root.n"), F.col("root.last") - F.col("root.n") + 1), lambda x: x["tag"].isin("li", "navpoint") & listed(x))

    def entry(x: Column) -> Column:
        below = lambda leaf, test: F.exists(leaf["path"], lambda a: (node(a)["parent"] == x["n"]) & test(node(a)["tag"]))
        own = F.filter(inside(x), lambda leaf: (leaf["tag"] == "#text") & F.when(x["tag"] == "li", ~below(leaf, lambda t: t.isin("ol", "ul"))).otherwise(below(leaf, lambda t: t == "navlabel")))
        label = F.btrim(F.regexp_replace(F.array_join(F.transform(own, lambda t: t["text"]), ""), r"\s+", " "))
        links = F.filter(inside(x), lambda y: (y["parent"] == x["n"]) & y["tag"].isin("a", "content"))
        href = F.try_element_at(F.get(links, 0)["attrs"], F.when(x["tag"] == "li", "href").otherwise("src"))
        path = F.filter(x["path"], lambda a: (a > F.col("root.n")) & node(a)["tag"].isin("li", "navpoint"))
        return F.struct(x["n"].alias("node"), x["last"].alias("last"), F.concat(path, F.array(x["n"])).alias("path"), F.nullif(label, F.lit("")).alias("label"), href.alias("href"))

    rows = rows.select(key, "nodes", "root", F.transform(items, entry).alias("entries"))
    said = lambda e: e["label"].isNotNull() | e["href"].isNotNull()
    kept = F.filter("entries", lambda e: said(e) | F.exists("entries", lambda f: (f["node"] > e["node"]) & (f["node"] <= e["last"]) & said(f)))
    each = rows.select(key, F.posexplode_outer(kept).alias("preorder", "e")).where(F.col("e").isNotNull())
    label = F.coalesce("e.label", "e.href", F.lit("Untitled section"))
    return each.select(key, F.col("e.node").alias("node"), F.try_element_at("e.path", F.lit(-2)).alias("parent"), (F.size("e.path") - 1).alias("depth"), F.col("preorder"), F.col("e.path").alias("path"), label.alias("label"), F.col("e.href").alias("href"))


def anchors_by_path(toc: DataFrame, by: list[str]) -> DataFrame:
    """The anchors that entries name in each file: where its blocks are split to chapters."""
    named = toc.select(*by, href_path(F.col("href")).alias("path"), F.lower(F.btrim(href_anchor(F.col("href")))).alias("anchor"))
    return named.where("anchor is not null and path <> ''").groupBy(*by, "path").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))


def label_at(places: DataFrame, toc: DataFrame) -> DataFrame:
    """(book, path, anchor) places with the label of the first entry in reading order at exactly that place."""
    named = toc.groupBy("book", F.col("path").alias("p"), F.col("anchor").alias("a")).agg(F.min_by("label", "preorder").alias("label"))
    return places.join(named.withColumnRenamed("book", "b"), (F.col("book") == F.col("b")) & (F.col("path") == F.col("p")) & F.col("anchor").eqNullSafe(F.col("a")), "left").drop("b", "p", "a")


def path_to_match(toc: DataFrame, by: list[str], exact: Column, else_: Column) -> DataFrame:
    """The path to the first node in reading order that matches exactly, or else loosely."""
    rank = F.when(exact, 0).when(else_, 1)
    return toc.withColumn("r", rank).where("r is not null").groupBy(*by).agg(F.min_by("path", F.struct("r", "preorder")).alias("path"))


def without_dead(toc: DataFrame, by: list[str], alive: Column) -> DataFrame:
    """The nodes that are alive or have a node below them that is."""
    above = toc.where(alive).select(*by, F.explode("path").alias("node")).distinct()
    return toc.join(above, [*by, "node"], "left_semi")


def first_entries(toc: DataFrame, by: list[str], chapter: str) -> DataFrame:
    """Each chapter's first entry in reading order, and how many entries lead to it."""
    return toc.where(F.col(chapter).isNotNull()).groupBy(*by, chapter).agg(F.min_by("label", "preorder").alias("label"), F.min("preorder").alias("preorder"), F.count("*").alias("entries"))
