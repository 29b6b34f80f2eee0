"""Queries that read an index or a layout instead of whole tables, and joins of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.intervals import overlap_join, running_starts
from pagemill.operators.trigrams import build_index, substring_search
from pagemill.sources.clustered import write_clustered
from pagemill.sources.kept import shared_folder
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}
#: What is searched for: words that are frequent, rare and absent, a phrase, a part of words, other letters, a short query.
SEARCHES = ["license", "Permission is hereby granted", " xyzzy plugh ", "tion ", "é", "ß", "zq", "general public"]
#: Characters of a page.
PAGE = 1800


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"SELECT q.query, doc_id FROM documents JOIN (SELECT DISTINCT lower(trim(unnest({SEARCHES!r}))) AS query) q ON contains(lower(text), q.query)")
def substring_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds a search text, found through the trigram index."""
    index = build_index(table(spark, d, "documents"), "doc_id", "text", shared_folder(spark, "trigrams"))
    return substring_search(index, SEARCHES).withColumnRenamed("id", "doc_id")


@query("""WITH top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1), e AS (SELECT max(ts) AS last FROM events)
SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE user_id = (SELECT user_id FROM top) AND ts BETWEEN (SELECT last - INTERVAL 7 DAY FROM e) AND (SELECT last FROM e)""")
def busiest_last_week(spark: SparkSession, d: str) -> DataFrame:
    """The events of the busiest user in the last seven days, read from a copy clustered by user and time."""
    events = table(spark, d, "events")
    user = events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).collect()
    last = events.agg(F.max("ts").alias("last")).first().last
    layout = write_clustered(events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "ts"], shared_folder(spark, "clustered"))
    if not user or last is None:
        found = events.limit(0)
    else:
        end = F.lit(last).cast("timestamp_ntz")
        found = layout.read(user_id=(user[0].user_id, user[0].user_id), ts=(end - F.expr("INTERVAL 7 DAYS"), end))
    return found.select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query(f"""WITH l AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
b AS (SELECT doc_id, block, length(line) AS size, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY block) - length(line) - 1 AS start FROM l),
p AS (SELECT doc_id, unnest(range(0, (length(text) + {PAGE - 1}) // {PAGE})) AS page FROM documents)
SELECT doc_id, page, min(block) AS first_block, count(*) AS n_blocks, CAST(min(start < page * {PAGE}) AS BOOLEAN) AS all_begin_before FROM p JOIN b USING (doc_id) WHERE size > 0 AND start < (page + 1) * {PAGE} AND start + size > page * {PAGE} GROUP BY doc_id, page""")
def first_visible_block(spark: SparkSession, d: str) -> DataFrame:
    """Of each page of a document (a window of characters) the first block that shows in it, and how many do."""
    docs = table(spark, d, "documents").select("doc_id", "text").where(F.col("text") != "")
    sizes = docs.select("doc_id", F.length("text").cast("long").alias("n"), F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long")).alias("sizes"))
    # Line ends count one each. A running sum by window would shuffle, a fold that appends would copy the array for each line.
    blocks = sizes.select("doc_id", "sizes", F.arrow_udf(running_starts, "array<long>")("sizes").alias("starts")).select("doc_id", F.posexplode(F.arrays_zip("starts", "sizes")).alias("block", "b"))
    blocks = blocks.select("doc_id", F.col("block").cast("long").alias("block"), F.col("b.starts").alias("start"), (F.col("b.starts") + F.col("b.sizes")).alias("end"))
    pages = sizes.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PAGE))).alias("page"))
    pages = pages.select("doc_id", "page", (F.col("page") * PAGE).alias("from_"), ((F.col("page") + 1) * PAGE).alias("to_"))
    shown = overlap_join(blocks, pages, ["doc_id"], ("start", "end"), ("from_", "to_"), PAGE)
    return shown.groupBy("doc_id", "page").agg(F.min("block").alias("first_block"), F.count("*").alias("n_blocks"), F.bool_and(F.col("start") < F.col("from_")).alias("all_begin_before"))
