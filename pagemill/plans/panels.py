"""Panels, sets and decisions: small relational pieces of the reading views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.relational import numbered
from pagemill.sources.css import style_rules
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""WITH g AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (
    SELECT conv_id, turn * 2 AS turn, split_part(text, chr(10), 1) AS text FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, text FROM conversations))
SELECT conv_id, turn, CASE WHEN starts_with(text, coalesce(before, '')) THEN substr(text, length(coalesce(before, '')) + 1) ELSE text END AS delta, before IS NOT NULL AND NOT starts_with(text, before) AS restarted FROM g""")
def text_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What each snapshot of a growing text adds to the one before it. Every turn gives two
    snapshots, its first line and its whole text; the next turn starts anew."""
    turns = table(spark, d, "conversations")
    half = turns.select("conv_id", (F.col("turn") * 2).alias("turn"), F.substring_index("text", "\n", 1).alias("text"))
    snapshots = half.union(turns.select("conv_id", F.col("turn") * 2 + 1, "text"))
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = snapshots.withColumn("before", before)
    grown = F.startswith("text", F.coalesce("before", F.lit("")))
    delta = F.when(grown, F.substring("text", F.length(F.coalesce("before", F.lit(""))) + 1, F.length("text"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", delta.alias("delta"), (F.col("before").isNotNull() & ~grown).alias("restarted"))


@query("SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of a book that are not stored yet."""
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("source", "doc_id")


@query("""WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT h.conv_id AS highlight, coalesce(c.source, 'unknown') AS chapter, CAST(row_number() OVER (PARTITION BY h.role ORDER BY c.idx IS NULL, c.idx DESC, h.turn DESC, h.conv_id) AS INTEGER) AS place, h.role, h.turn FROM conversations h LEFT JOIN c ON c.doc_id = h.conv_id""")
def highlights_panel(spark: SparkSession, d: str) -> DataFrame:
    """Highlights with a known chapter first, later chapters first, newest first."""
    c = table(spark, d, "documents").select("doc_id", "source", (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).alias("idx"))
    h = table(spark, d, "conversations").select(F.col("conv_id").alias("highlight"), "role", "turn")
    joined = h.join(c, F.col("highlight") == F.col("doc_id"), "left")
    rows = joined.select("highlight", F.coalesce("source", F.lit("unknown")).alias("chapter"), "role", "turn", "idx", F.col("idx").isNull().alias("unknown"))
    return numbered(rows, ["role"], [F.asc("unknown"), F.desc("idx"), F.desc("turn"), F.asc("highlight")], "place").drop("idx", "unknown")


@query("""SELECT c_nationkey AS shelf, o_orderkey AS item, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS position FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""")
def membership_order(spark: SparkSession, d: str) -> DataFrame:
    """A shelf's members in the order of their membership."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("item"), "o_totalprice")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("shelf")).join(o, "c_custkey")
    return rows.select("shelf", "item", F.row_number().over(W.partitionBy("shelf").orderBy("o_totalprice", "item")).cast("long").alias("position"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 10 = 9 AND p_partkey % 3 = 2 THEN 'next-chapter' WHEN p_size % 10 = 0 AND p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'stay' ELSE 'previous-chapter' END
    WHEN p_partkey % 3 = 2 THEN 'page ' || (p_size % 10 + 1) WHEN p_partkey % 3 = 0 THEN 'page ' || (p_size % 10 - 1) ELSE 'stay' END AS decision FROM part""")
def pagination_decision(spark: SparkSession, d: str) -> DataFrame:
    """A step forward or back from a page of ten: a page, a neighbouring chapter, or nowhere."""
    page, step = F.col("p_size") % 10, F.col("p_partkey") % 3 - 1
    back = F.when(F.col("p_partkey") % 7 == 0, "stay").otherwise("previous-chapter")
    to = lambda n: F.concat(F.lit("page "), n.cast("string"))
    decision = F.when((page == 9) & (step == 1), "next-chapter").when((page == 0) & (step == -1), back).when(step == 1, to(page + 1)).when(step == -1, to(page - 1)).otherwise("stay")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), decision.alias("decision"))


@query("""SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'P' THEN 'UNSUPPORTED' WHEN count(l_orderkey) = 0 THEN 'PROCESSING' WHEN bool_and(l_returnflag = 'R') THEN 'FAILED' ELSE 'READY' END AS status,
    coalesce(min(l_linenumber) FILTER (WHERE l_linenumber >= 3), min(l_linenumber)) AS chapter FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def reader_status(spark: SparkSession, d: str) -> DataFrame:
    """Payload status, and the chapter to open: the requested one or later, else the first."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("lost"), F.min(F.when(F.col("l_linenumber") >= 3, F.col("l_linenumber"))).alias("asked"), F.min("l_linenumber").alias("first"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "P", "UNSUPPORTED").when(F.col("l_orderkey").isNull(), "PROCESSING").when(F.col("lost"), "FAILED").otherwise("READY")
    return rows.select(F.col("o_orderkey").alias("item_id"), status.alias("status"), F.coalesce("asked", "first").alias("chapter"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>([^<]*)</style>', 1), chr(10)), '(?s)/\*.*?\*/', '', 'g') AS css FROM pages),
r AS (SELECT page_id, unnest(regexp_extract_all(css, '([^{}]+)\{([^{}]*)\}', 1)) AS heads, unnest(regexp_extract_all(css, '([^{}]+)\{([^{}]*)\}', 2)) AS body, generate_subscripts(regexp_extract_all(css, '([^{}]+)\{([^{}]*)\}', 1), 1) AS a FROM c),
h AS (SELECT page_id, a, body, trim(unnest(string_split(heads, ','))) AS head, generate_subscripts(string_split(heads, ','), 1) AS b FROM r),
x AS (SELECT page_id, a, b, head, unnest(string_split(body, ';')) AS said, generate_subscripts(string_split(body, ';'), 1) AS c FROM h WHERE regexp_matches(head, '^([a-z][a-z0-9]*|\.[A-Za-z_][\w-]*|[a-z][a-z0-9]*\.[A-Za-z_][\w-]*)$')),
p AS (SELECT page_id, a, b, c, head, lower(trim(split_part(said, ':', 1))) AS name, regexp_replace(trim(substr(said, strpos(said, ':') + 1)), '(?i)\s*!important\s*$', '') AS value FROM x WHERE contains(said, ':'))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a, b, c) AS INTEGER) AS n, head AS selector, name AS property, value FROM p WHERE name <> '' AND value <> ''""")
def page_style_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of the style sheets that pages carry."""
    sheets = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>([^<]*)</style>"), F.lit(1)), "\n")
    return style_rules(table(spark, d, "pages").select("page_id", sheets.alias("css")), "page_id", "css")
