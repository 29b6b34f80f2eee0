"""Dashboard, library and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import book_slug
from pagemill.functions.timing import day, last_days, millis
from pagemill.operators.relational import counts_of_domain, top_per_group, with_details
from pagemill.sources.tables import items, progress, shelves, table, with_sql

TODAY, GOAL_MINUTES = "2024-01-30", 60
KINDS = ["signup", "purchase", "view", "click", "error", "share"]

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT user_id, CAST(floor(coalesce(sum(CAST(floor(value * 60) AS BIGINT)), 0) / 3600) AS BIGINT) AS hours,
    count(*) FILTER (WHERE event_type = 'click') AS highlights, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 100) AS volumes,
    count(*) FILTER (WHERE event_type = 'view') AS comments FROM events GROUP BY user_id""")
def home_stats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.floor(F.coalesce(F.sum(F.floor(F.col("value") * 60).cast("long")), F.lit(0)) / 3600).cast("long").alias("hours"),
        F.count_if(kind == "click").alias("highlights"), F.count_if((kind == "purchase") & (F.col("value") >= 100)).alias("volumes"), F.count_if(kind == "view").alias("comments"))


@query(f"""WITH seconds AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(floor(value * 60) AS BIGINT)) AS s FROM events
    WHERE CAST(ts AS DATE) >= DATE '{TODAY}' - 6 AND CAST(ts AS DATE) <= DATE '{TODAY}' GROUP BY ALL),
days AS (SELECT CAST(DATE '{TODAY}' - CAST(i AS INTEGER) AS DATE) AS day FROM range(7) t(i))
SELECT u.user_id, CAST(days.day AS VARCHAR) AS day, CAST(floor(coalesce(s, 0) / 60) AS BIGINT) AS minutes, floor(coalesce(s, 0) / 60) >= {GOAL_MINUTES} AS goal_met
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN days LEFT JOIN seconds ON seconds.user_id = u.user_id AND seconds.day = days.day""")
def mastery_7d(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    start = F.date_sub(F.to_date(F.lit(TODAY)), 6)
    recent = events.where((F.col("ts") >= start.cast("timestamp_ntz")) & (day(F.col("ts")) <= F.to_date(F.lit(TODAY))))
    seconds = recent.groupBy("user_id", day(F.col("ts")).alias("day")).agg(F.sum(F.floor(F.col("value") * 60).cast("long")).alias("s"))
    calendar = events.select("user_id").distinct().withColumn("day", F.explode(last_days(TODAY)))
    minutes = F.floor(F.coalesce("s", F.lit(0)) / 60).cast("long")
    return calendar.join(seconds, ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), minutes.alias("minutes"), (minutes >= GOAL_MINUTES).alias("goal_met"))


@query(with_sql("items", "progress") + """ SELECT user_id, item_id, pct, engaged_ms FROM (
    SELECT user_id, item_id, coalesce(pct, 0) AS pct, greatest(coalesce(read_ms, 0), added_ms) AS engaged_ms FROM items LEFT JOIN progress USING (item_id) WHERE NOT archived)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY engaged_ms DESC, item_id) = 1""")
def current_engagement(spark: SparkSession, d: str) -> DataFrame:
    joined = items(spark, d).where("not archived").join(progress(spark, d), "item_id", "left")
    engaged = F.greatest(F.coalesce("read_ms", F.lit(0)), "added_ms").alias("engaged_ms")
    rows = joined.select("user_id", "item_id", F.coalesce("pct", F.lit(0)).alias("pct"), engaged)
    best = F.max_by(F.struct("item_id", "pct", "engaged_ms"), F.struct("engaged_ms", (-F.col("item_id")).alias("t")))
    return rows.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


CATALOG = "SELECT p_partkey AS book_id, p_size <= 10 AS featured, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS featured_rank, p_size % 7 AS sort_order, p_retailprice AS updated FROM part"
CATALOG_ORDER = "ORDER BY featured DESC, featured_rank ASC NULLS LAST, sort_order, updated DESC, book_id"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_brand").alias("brand"), (size <= 10).alias("featured"), F.when(size % 3 != 0, size).alias("featured_rank"), (size % 7).alias("sort_order"), F.col("p_retailprice").alias("updated"))


_CATALOG_ORDER = [F.desc, F.asc_nulls_last, F.asc, F.desc, F.asc]


def _catalog_order():
    return [f(c) for f, c in zip(_CATALOG_ORDER, ["featured", "featured_rank", "sort_order", "updated", "book_id"])]


@query(f"SELECT * FROM ({CATALOG}) {CATALOG_ORDER} LIMIT 2")
def featured_top2(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).drop("brand").orderBy(*_catalog_order()).limit(2)


@query(f"SELECT p_brand AS brand, book_id, CAST(row_number() OVER (PARTITION BY p_brand {CATALOG_ORDER}) AS INTEGER) AS place FROM ({CATALOG}) c JOIN part ON p_partkey = book_id")
def catalog_order(spark: SparkSession, d: str) -> DataFrame:
    rows = top_per_group(_catalog(spark, d), ["brand"], _catalog_order(), 1 << 30, "place")
    return rows.select("brand", "book_id", "place")


@query("""SELECT c_nationkey AS nation, o_orderkey AS note_id, c_name AS reader, (epoch_us(o_orderdate) // 1000) AS created_ms, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank
    FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 3""")
def recent_annotations_top3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("nation"), F.col("o_orderkey").alias("note_id"), F.col("c_name").alias("reader"), millis(F.col("o_orderdate")).alias("created_ms"))
    return top_per_group(rows, ["nation"], [F.desc("created_ms"), F.asc("note_id")], 3)


@query(with_sql("items", "progress", "shelves") + """ SELECT shelf, sort_order, count(item_id) AS books, count(item_id) FILTER (WHERE coalesce(pct, 0) < 100) AS unread
    FROM shelves LEFT JOIN items USING (user_id) LEFT JOIN progress USING (item_id) GROUP BY ALL ORDER BY sort_order, shelf LIMIT 6""")
def home_collections_top6(spark: SparkSession, d: str) -> DataFrame:
    rows = shelves(spark, d).join(items(spark, d), "user_id", "left").join(progress(spark, d), "item_id", "left")
    counted = rows.groupBy("shelf", "sort_order").agg(F.count("item_id").alias("books"), F.count_if(F.col("item_id").isNotNull() & (F.coalesce("pct", F.lit(0)) < 100)).alias("unread"))
    return counted.orderBy("sort_order", "shelf").limit(6)


@query(with_sql("items", "progress", "shelves") + """, ranked AS (SELECT shelf, item_id, coalesce(pct, 0) AS pct, greatest(coalesce(read_ms, 0), added_ms) AS engaged_ms
    FROM shelves JOIN items USING (user_id) LEFT JOIN progress USING (item_id) WHERE NOT archived),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY shelf ORDER BY engaged_ms DESC, item_id) AS INTEGER) AS rank FROM ranked QUALIFY rank <= 4)
SELECT shelf, rank, top.item_id, pct, priority FROM top JOIN items USING (item_id)""")
def library_preview_top4(spark: SparkSession, d: str) -> DataFrame:
    held = shelves(spark, d).join(items(spark, d).where("not archived"), "user_id").join(progress(spark, d), "item_id", "left")
    engaged = F.greatest(F.coalesce("read_ms", F.lit(0)), "added_ms")
    narrow = held.select("shelf", "item_id", F.coalesce("pct", F.lit(0)).alias("pct"), engaged.alias("engaged_ms"))
    top = top_per_group(narrow, ["shelf"], [F.desc("engaged_ms"), F.asc("item_id")], 4)
    return with_details(top, items(spark, d).select("item_id", "priority"), ["item_id"]).select("shelf", "rank", "item_id", "pct", "priority")


@query(with_sql("items", "shelves") + ", s AS (SELECT shelf, count(item_id) AS n FROM shelves JOIN items USING (user_id) WHERE NOT archived GROUP BY shelf) SELECT CAST(count(*) AS BIGINT) AS shelves, CAST(sum(n) AS BIGINT) AS books FROM s")
def library_summary_nondistinct(spark: SparkSession, d: str) -> DataFrame:
    n = shelves(spark, d).join(items(spark, d).where("not archived"), "user_id").groupBy("shelf").agg(F.count("item_id").alias("n"))
    return n.agg(F.count("*").alias("shelves"), F.sum("n").alias("books"))


@query("SELECT count(DISTINCT l_partkey) AS books, count(DISTINCT l_orderkey) AS items FROM lineitem")
def library_summary_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("books"), F.count_distinct("l_orderkey").alias("items"))


@query("""SELECT o_orderkey AS item_id, count(l_partkey) AS files, coalesce(string_agg(p_name || ':' || l_linenumber, ';' ORDER BY l_linenumber, l_partkey, p_name), '') AS listing
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def item_detail_nested(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(parts, "l_partkey", "left")
    nested = lines.groupBy("l_orderkey").agg(F.count("l_partkey").alias("files"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("f"))
    listing = F.array_join(F.transform("f", lambda x: F.concat(x["p_name"], F.lit(":"), x["l_linenumber"].cast("string"))), ";")
    joined = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id")).join(nested, F.col("item_id") == F.col("l_orderkey"), "left")
    return joined.select("item_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce(listing, F.lit("")).alias("listing"))


@query("""SELECT l_orderkey AS item_id, arg_min(l_shipmode, (l_order, l_partkey)) AS format FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 0 WHEN l_linenumber = 1 THEN 1 END AS l_order, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)
    WHERE l_order IS NOT NULL GROUP BY ALL UNION ALL SELECT DISTINCT l_orderkey, 'UNKNOWN' FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def primary_file_pick(spark: SparkSession, d: str) -> DataFrame:
    """The format of an item's primary file. Of files that rank alike the first in the table's files
    counts, as in the SQL on one thread; files without a format don't count."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") == 1).alias("primary"), (F.col("l_returnflag") == "N").alias("new"), F.concat("l_returnflag", "l_linestatus").alias("format"), "_metadata.file_path", "_metadata.row_index")
    rank = F.struct(F.when(F.col("new"), 0).otherwise(1), F.col("l_partkey").isNull(), "l_partkey", "file_path", "row_index")
    fmt = F.min_by("format", F.when(F.col("primary") & F.col("format").isNotNull(), rank))
    rows = li.groupBy(F.col("l_orderkey").alias("item_id")).agg(fmt.alias("format"), F.max(F.coalesce("primary", F.lit(False))).alias("has"))
    return rows.select("item_id", F.when(F.col("has"), F.col("format")).otherwise("UNKNOWN").alias("format"))


@query("SELECT p_partkey AS book_id, p_name AS title, p_brand AS author FROM part WHERE p_partkey = 17 OR (p_name = 'small ring' AND p_brand = 'Brand#2')")
def lookup_id_or_slug(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    return rows.where((F.col("book_id") == 17) | (book_slug(F.col("title"), F.col("author")) == "small-ring-by-brand-2"))


@query("""SELECT p_partkey AS blob_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 7 AND l_quantity > 40) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)""")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    rows = table(spark, d, "part").select("p_partkey")
    for used in ("l_returnflag = 'R' and l_quantity > 45", "l_linenumber = 7 and l_quantity > 40", "l_quantity > 49"):
        rows = rows.join(li.where(used).select("p_partkey"), "p_partkey", "left_anti")
    return rows.select(F.col("p_partkey").alias("blob_id"))


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def users_with_items(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(owners, "c_custkey", "left_semi").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


_KINDS = ", ".join(f"('{k}')" for k in KINDS)


@query(f"SELECT u.user_id, k.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES {_KINDS}) k(event_type) LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.event_type GROUP BY ALL")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts_of_domain(table(spark, d, "events").select("user_id", "event_type"), ["user_id"], "event_type", KINDS)


@query(with_sql("items", "progress") + """ SELECT user_id, priority, count(*) AS n, CAST(sum(CASE WHEN coalesce(pct, 0) >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) FILTER (WHERE added_ms >= 946684800000) AS recent
    FROM items LEFT JOIN progress USING (item_id) WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD')) GROUP BY ALL""")
def owner_scoped_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every owner's items by priority; owners of one of the known segments."""
    owners = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD")).select(F.col("c_custkey").alias("user_id"))
    rows = items(spark, d).join(owners, "user_id", "left_semi").join(progress(spark, d), "item_id", "left")
    return rows.groupBy("user_id", "priority").agg(F.count("*").alias("n"), F.count_if(F.coalesce("pct", F.lit(0)) >= 100).alias("finished"), F.count_if(F.col("added_ms") >= 946684800000).alias("recent"))
