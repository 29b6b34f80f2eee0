"""Change-log and retry queries: events stand for queued edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.numbers import backoff_ms, failure_kind, session_failure_kind
from pagemill.operators.changes import coalesced, dirty_merge, drained, merged, sendable
from pagemill.operators.relational import delete, first_of_each, insert_if_absent, patch, replace_snapshot, upsert
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}
STATUS = [200, 401, 404, 409, 429, 503, 418, 422]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: The stored table are customers, the log all events on them; a device's events are under user_id * 10 + the device.
LOG = "log AS (SELECT event_id AS seq, user_id * 10 + length(event_type) AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CAST(floor(value * 100) AS BIGINT) AS v, event_type AS kind FROM events)"
SNAPSHOT = "snapshot AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS v, c_mktsegment AS kind FROM customer)"
#: Two overlapping lots of all parts: those up to size 32 are stored, those from 20 on come in.
STORED = "stored AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS v, p_name AS kind FROM part WHERE p_size <= 32)"
BATCH = "batch AS (SELECT p_partkey AS id, CAST(1000 + p_size AS BIGINT) AS v, p_brand AS kind FROM part WHERE p_size >= 20)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 10 + F.length("event_type")).alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.floor(F.col("value") * 100).cast("long").alias("v"), F.col("event_type").alias("kind"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("v"), F.col("c_mktsegment").alias("kind"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 32").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("v"), F.col("p_name").alias("kind"))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size >= 20").select(F.col("p_partkey").alias("id"), (1000 + F.col("p_size")).cast("long").alias("v"), F.col("p_brand").alias("kind"))


@query(f"WITH {LOG} SELECT id, seq, op, v FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def queue_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return coalesced(_log(spark, d), "id", "seq").select("id", "seq", "op", "v")


@query(f"""WITH {LOG}, {SNAPSHOT}, p AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, v, kind, false AS pending FROM snapshot WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT id, v, kind, true FROM p WHERE op <> 'delete'""")
def merge_snapshot_pending(spark: SparkSession, d: str) -> DataFrame:
    return merged(_snapshot(spark, d), _log(spark, d), "id", "seq", "op", ["v", "kind"])


@query(f"""WITH {LOG}, {SNAPSHOT}, p AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, seq, op FROM p WHERE NOT (op = 'delete' AND id NOT IN (SELECT id FROM snapshot))""")
def queue_sendable(spark: SparkSession, d: str) -> DataFrame:
    return sendable(_log(spark, d), _snapshot(spark, d), "id", "seq", "op").select("id", "seq", "op")


_CODES = "[" + ", ".join(map(str, STATUS)) + "]"
_KIND = "CASE WHEN s IN (401, 408, 425, 429) OR s BETWEEN 500 AND 599 THEN 'retry' WHEN s IN (400, 403, 404, 409, 410, 413, 415, 422) THEN 'drop' ELSE 'retry' END"


def _status():
    return F.get(F.array(*map(F.lit, STATUS)), (F.col("event_id") * 5 % len(STATUS)).cast("int"))


@query(f"""WITH q AS (SELECT user_id, event_id, {_CODES}[event_id * 5 % {len(STATUS)} + 1] AS s FROM events),
o AS (SELECT *, CASE WHEN s < 300 THEN 'sent' ELSE {_KIND} END AS outcome FROM q)
SELECT user_id, event_id, outcome, CASE WHEN coalesce(max(CASE WHEN outcome = 'retry' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'waiting' ELSE outcome END AS state FROM o""")
def queue_drain_blocking(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").select("user_id", "event_id", _status().alias("s"))
    return drained(q, "user_id", "event_id", F.when(F.col("s") < 300, "sent").otherwise(failure_kind(F.col("s")))).drop("s")


@query(f"""WITH q AS (SELECT event_id, {_CODES}[event_id * 5 % {len(STATUS)} + 1] AS s, event_id % 12 AS attempt FROM events)
SELECT event_id, {_KIND} AS failure, CASE WHEN s IN (401, 408, 425, 429) OR s BETWEEN 500 AND 599 THEN 'retry' ELSE 'drop' END AS session_failure, CAST(least(30000, 1000 * pow(2, attempt)) AS BIGINT) AS wait_ms FROM q""")
def retry_class(spark: SparkSession, d: str) -> DataFrame:
    s = _status()
    return table(spark, d, "events").select("event_id", failure_kind(s).alias("failure"), session_failure_kind(s).alias("session_failure"), backoff_ms(F.col("event_id") % 12).alias("wait_ms"))


@query("""SELECT c.c_custkey AS user_id, CASE WHEN l.user_id IS NOT NULL AND l.n % 2 = 0 THEN 'local' ELSE c.c_mktsegment END AS theme, CASE WHEN l.user_id IS NOT NULL AND l.n % 3 = 0 THEN l.n ELSE c.c_nationkey END AS size
    FROM customer c LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) l ON l.user_id = c.c_custkey""")
def pref_field_merge(spark: SparkSession, d: str) -> DataFrame:
    server = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("theme"), F.col("c_nationkey").cast("long").alias("size"))
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("size"))
    dirty = F.array_compact(F.array(F.when(F.col("size") % 2 == 0, "theme"), F.when(F.col("size") % 3 == 0, "size")))
    local = n.select("user_id", F.lit("local").alias("theme"), "size", dirty.alias("dirty"))
    return dirty_merge(server, local, "user_id", ["theme", "size"], "dirty")


@query("""SELECT s.p_partkey AS id, s.p_size AS size, CASE WHEN coalesce(l.dirty, false) THEN l.wanted ELSE s.p_size % 2 = 0 END AS wanted, l.cached, coalesce(l.dirty, false) AS dirty
    FROM part s LEFT JOIN (SELECT p_partkey, p_partkey % 5 = 0 AS dirty, p_partkey % 4 = 0 AS wanted, p_name AS cached FROM part WHERE p_partkey % 3 = 0) l USING (p_partkey)""")
def snapshot_replace_dirty(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    local = p.where(key % 3 == 0).select(key.alias("id"), (key % 5 == 0).alias("dirty"), (key % 4 == 0).alias("wanted"), F.col("p_name").alias("cached"))
    server = p.select(key.alias("id"), F.col("p_size").alias("size"), (F.col("p_size") % 2 == 0).alias("wanted"))
    return replace_snapshot(local, server, "id", ["cached"], "dirty", ["wanted"])


@query("""SELECT c_custkey AS user_id, CASE WHEN e.n IS NULL THEN c_mktsegment WHEN e.n % 2 = 0 THEN NULL ELSE c_mktsegment END AS theme, CASE WHEN e.n % 3 = 0 THEN CAST(e.n AS BIGINT) ELSE CAST(c_nationkey AS BIGINT) END AS goal
    FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def preference_patch(spark: SparkSession, d: str) -> DataFrame:
    """A patch to null clears; a field the patch doesn't name stays."""
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("theme"), F.col("c_nationkey").cast("long").alias("goal"))
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("goal"))
    changes = n.select("user_id", F.lit(None).cast("string").alias("theme"), "goal", (F.col("goal") % 2 == 0).alias("has_theme"), (F.col("goal") % 3 == 0).alias("has_goal"))
    return patch(stored, changes, "user_id", ["theme", "goal"])


@query(f"WITH {STORED}, {BATCH} SELECT * FROM batch UNION ALL SELECT * FROM stored WHERE id NOT IN (SELECT id FROM batch)")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    return upsert(_stored(spark, d), _batch(spark, d), ["id"])


@query(f"WITH {STORED}, {BATCH} SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE id NOT IN (SELECT id FROM stored)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    return insert_if_absent(_stored(spark, d), _batch(spark, d), ["id"])


@query("""WITH b AS (SELECT o_custkey AS owner, o_orderpriority AS shelf, min(o_orderkey) AS first_item FROM orders GROUP BY ALL), s AS (SELECT c_custkey AS owner, '3-MEDIUM' AS shelf, CAST(-1 AS BIGINT) AS first_item FROM customer)
SELECT * FROM s UNION ALL SELECT * FROM b WHERE shelf <> '3-MEDIUM'  OR owner NOT IN (SELECT owner FROM s)""")
def bulk_insert_skip_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """A batch that repeats keys: of each key one row, the smallest, and only if it is not stored."""
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.lit("3-MEDIUM").alias("shelf"), F.lit(-1).cast("long").alias("first_item"))
    batch = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("shelf"), F.col("o_orderkey").alias("first_item"))
    return insert_if_absent(stored, first_of_each(batch, ["owner", "shelf"], "first_item"), ["owner", "shelf"])


@query(f"WITH {STORED}, {BATCH} SELECT * FROM stored WHERE id NOT IN (SELECT id FROM batch)")
def idempotent_delete(spark: SparkSession, d: str) -> DataFrame:
    return delete(_stored(spark, d), _batch(spark, d), ["id"])


@query("""WITH f AS (SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus = 'F' AS was FROM lineitem)
SELECT l_orderkey AS item_id, l_partkey AS file_id, l_linenumber AS n, CASE WHEN was AND l_linenumber < max(CASE WHEN was THEN l_linenumber ELSE 0 END) OVER (PARTITION BY l_orderkey) THEN false ELSE was END AS is_primary FROM f""")
def demote_primaries(spark: SparkSession, d: str) -> DataFrame:
    """A new primary file demotes the ones before it."""
    from pyspark.sql import Window as W

    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("file_id"), F.col("l_linenumber").alias("n"), (F.col("l_linestatus") == "F").alias("was"))
    newest = F.max(F.when(F.col("was"), F.col("n")).otherwise(0)).over(W.partitionBy("item_id"))
    return f.select("item_id", "file_id", "n", F.when(F.col("was") & (F.col("n") < newest), False).otherwise(F.col("was")).alias("is_primary"))
