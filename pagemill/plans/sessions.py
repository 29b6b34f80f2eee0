"""Session, replay and statistics queries over device events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.timing import elapsed_seconds, millis, split_by_day
from pagemill.operators.changes import last_write
from pagemill.operators.relational import add_up, top_per_group
from pagemill.operators.sessions import accrue, day_segments, replayed
from pagemill.sources.tables import table
from pagemill.streaming.client_sessions import client_session_log
from pagemill.streaming.session_state import session_log

from .dashboard import GOAL_MINUTES

QUERIES, SQL = {}, {}
NOW_MS = 1706659200000  # 2024-01-31


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _accrued_sql(idle_s: int) -> str:
    return f"""WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events), c AS (
    SELECT *, CASE WHEN event_type <> 'error' THEN least(ms + {idle_s * 1000}, coalesce(lead(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id), 4611686018427387904)) END AS covers, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS prev_ms FROM e
), a AS (SELECT *, coalesce(max(covers) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= ms, false) AS active_before FROM c
), x AS (SELECT *, CASE WHEN active_before THEN greatest(0, (ms - prev_ms + 500) // 1000) ELSE 0 END AS elapsed FROM a)"""


def _accrued(spark: SparkSession, d: str, idle_s: int) -> DataFrame:
    return accrue(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", F.col("event_type") == "error", idle_s * 1000)


@query(_accrued_sql(1800) + " SELECT event_id, user_id, active_before, CAST(elapsed AS BIGINT) AS elapsed FROM x")
def session_accrual(spark: SparkSession, d: str) -> DataFrame:
    return _accrued(spark, d, 1800).select("event_id", "user_id", "active_before", "elapsed")


@query(_accrued_sql(21600) + " SELECT user_id, CAST(sum(elapsed) AS BIGINT) AS seconds, CAST(floor(sum(elapsed) / 60) AS BIGINT) AS minutes, count(*) FILTER (WHERE active_before) AS active FROM x GROUP BY user_id")
def session_accrual_6h(spark: SparkSession, d: str) -> DataFrame:
    return _accrued(spark, d, 21600).groupBy("user_id").agg(F.sum("elapsed").alias("seconds"), F.floor(F.sum("elapsed") / 60).cast("long").alias("minutes"), F.count_if("active_before").alias("active"))


@query(_accrued_sql(21600) + """, s AS (SELECT user_id, prev_ms // 1000 AS a, prev_ms // 1000 + elapsed AS b FROM x WHERE elapsed > 0),
p AS (SELECT user_id, d, least(b, (d + 1) * 86400) - greatest(a, d * 86400) AS n FROM (SELECT *, unnest(range(a // 86400, (b - 1) // 86400 + 1)) AS d FROM s))
SELECT user_id, CAST(CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS DATE) AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS seconds FROM p GROUP BY ALL""")
def day_split_segments(spark: SparkSession, d: str) -> DataFrame:
    return day_segments(_accrued(spark, d, 21600), "user_id").select("user_id", F.col("day").cast("string").alias("day"), "seconds")


@query()
def session_ids_and_end(spark: SparkSession, d: str) -> DataFrame:
    """Session identities need each device's liveness in order: one state machine a key."""
    return session_log(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), 21_600_000)


CLIENT_IDLE_MS, CLIENT_TTL_MS = 21_600_000, 5 * 86_400_000


def client_actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as session actions: errors stop, views and purchases are heartbeats, the others start.
    A client id repeats, and one of seven actions has none."""
    kind, number = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "error", "stop").when(kind.isin("view", "purchase"), "heartbeat").otherwise("start")
    client = F.when(number % 7 > 0, F.concat(F.lit("c"), (number % 5).cast("string")))
    item = F.concat(F.lit("i"), F.pmod(F.floor(F.col("value")).cast("long"), F.lit(2)).cast("string"))
    return table(spark, d, "events").select("event_id", "user_id", "ts", item.alias("item"), action.alias("action"), kind.alias("device"), client.alias("client"))


@query()
def client_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Reopening, adoption and the time to live depend on each session's state in order: one state machine a user."""
    return client_session_log(client_actions(spark, d), CLIENT_IDLE_MS, CLIENT_TTL_MS)


@query("SELECT user_id, event_type, event_id, (epoch_us(ts) // 1000) AS last_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def active_session_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", millis(F.col("ts")).alias("last_ms"), "ts")
    return top_per_group(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 1).drop("rank", "ts")


@query("SELECT user_id, event_type AS item, CAST(floor(sum(CAST(floor(value * 60) AS BIGINT)) / 60.0) AS BIGINT) AS minutes FROM events GROUP BY ALL")
def minutes_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("item")).agg(F.floor(F.sum(F.floor(F.col("value") * 60).cast("long")) / 60).cast("long").alias("minutes"))


#: Offline sessions: an event's span is value - 2 hours from its time; its client key repeats.
OFFLINE_SQL = "offline AS (SELECT event_id, user_id, event_type, event_id % 40 AS client_key, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + CAST(floor((value - 2) * 3600) AS BIGINT) * 1000 AS end_ms FROM events)"


def offline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", (F.col("event_id") % 40).alias("client_key"), millis(F.col("ts")).alias("start_ms"), (millis(F.col("ts")) + F.floor((F.col("value") - 2) * 3600).cast("long") * 1000).alias("end_ms"))


@query(f"""WITH {OFFLINE_SQL}, v AS (SELECT * FROM offline WHERE end_ms >= start_ms QUALIFY row_number() OVER (PARTITION BY user_id, client_key ORDER BY event_id) = 1)
SELECT event_id, user_id, client_key, (end_ms - start_ms + 500) // 1000 AS requested, least((end_ms - start_ms + 500) // 1000, 86400) AS seconds, (end_ms - start_ms + 500) // 1000 > 86400 AS clamped FROM v""")
def replay_idempotent_clamp(spark: SparkSession, d: str) -> DataFrame:
    return replayed(offline(spark, d), ["user_id", "client_key"], "start_ms", "end_ms", "event_id").select("event_id", "user_id", "client_key", "requested", "seconds", "clamped")


@query(f"""WITH {OFFLINE_SQL}, v AS (SELECT user_id, start_ms // 1000 AS a, start_ms // 1000 + least((end_ms - start_ms + 500) // 1000, 86400) AS b FROM offline WHERE end_ms > start_ms QUALIFY row_number() OVER (PARTITION BY user_id, client_key ORDER BY event_id) = 1),
p AS (SELECT user_id, d, least(b, (d + 1) * 86400) - greatest(a, d * 86400) AS n FROM (SELECT *, unnest(range(a // 86400, (b - 1) // 86400 + 1)) AS d FROM v WHERE b > a))
SELECT user_id, CAST(CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS DATE) AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS seconds FROM p GROUP BY ALL""")
def replay_day_split(spark: SparkSession, d: str) -> DataFrame:
    rows = replayed(offline(spark, d).where("end_ms > start_ms"), ["user_id", "client_key"], "start_ms", "end_ms", "event_id")
    spans = rows.select("user_id", F.explode(split_by_day(F.floor(F.col("start_ms") / 1000), F.col("seconds"))).alias("s"))
    return spans.groupBy("user_id", F.col("s.day").cast("string").alias("day")).agg(F.sum("s.seconds").alias("seconds"))


@query("SELECT user_id, arg_max(event_type, ((epoch_us(ts) // 1000) // 86400000, event_id)) AS locator, arg_max(event_id, ((epoch_us(ts) // 1000) // 86400000, event_id)) AS event_id FROM events GROUP BY user_id")
def lww_progress(spark: SparkSession, d: str) -> DataFrame:
    """The reading time has day precision here, so that ties occur: the later arrival wins them."""
    rows = table(spark, d, "events").withColumn("locator", F.col("event_type"))
    return last_write(rows, "user_id", F.floor(millis(F.col("ts")) / 86400000), F.col("event_id"), ["locator", "event_id"])


@query("""WITH l AS (SELECT user_id, max((epoch_us(ts) // 1000)) // 86400000 AS saved FROM events WHERE event_type = 'view' GROUP BY 1), s AS (SELECT user_id, max((epoch_us(ts) // 1000)) // 86400000 AS saved FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(l.user_id, s.user_id) AS user_id, CASE WHEN l.saved IS NOT NULL AND l.saved >= coalesce(s.saved, -1) THEN 'local' ELSE 'server' END AS source FROM l FULL JOIN s ON l.user_id = s.user_id""")
def resume_choice(spark: SparkSession, d: str) -> DataFrame:
    """The local place (a view) or the server's (a click), by the later day; users without either have none."""
    at = F.floor(millis(F.col("ts")) / 86400000)
    mine, theirs = (F.max(F.when(F.col("event_type") == k, at)) for k in ("view", "click"))
    both = table(spark, d, "events").where(F.col("event_type").isin("view", "click")).groupBy("user_id").agg(mine.alias("l"), theirs.alias("s"))
    return both.select("user_id", F.when(F.col("l").isNotNull() & (F.col("l") >= F.coalesce("s", F.lit(-1))), "local").otherwise("server").alias("source"))


_DELTAS_SQL = f"""WITH {OFFLINE_SQL}, closed AS (SELECT user_id, event_type AS item, start_ms, greatest(0, (end_ms - start_ms + 500) // 1000) AS s FROM offline WHERE event_type <> 'signup' AND end_ms >= start_ms)"""


def _closed(spark: SparkSession, d: str) -> DataFrame:
    rows = offline(spark, d).where("event_type <> 'signup' and end_ms >= start_ms")
    return rows.select("user_id", F.col("event_type").alias("item"), "start_ms", elapsed_seconds(F.col("start_ms"), F.col("end_ms")).alias("s")).where("s > 0")


@query(_DELTAS_SQL + """ SELECT user_id, 'total' AS part, '' AS name, CAST(sum(s) AS BIGINT) AS seconds FROM closed WHERE s > 0 GROUP BY user_id
UNION ALL SELECT user_id, 'item', item, CAST(sum(s) AS BIGINT) FROM closed WHERE s > 0 GROUP BY user_id, item
UNION ALL SELECT user_id, 'day', strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS day, CAST(sum(s) AS BIGINT) FROM closed WHERE s > 0 GROUP BY user_id, day""")
def unsynced_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Total, by item and by start day in one pass over grouping sets."""
    rows = _closed(spark, d).withColumn("day", F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd"))
    sets = rows.groupingSets([["user_id"], ["user_id", "item"], ["user_id", "day"]], "user_id", "item", "day").agg(F.sum("s").alias("seconds"), F.grouping_id().alias("g"))
    part = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "item").otherwise("day")
    return sets.select("user_id", part.alias("part"), F.coalesce("item", "day", F.lit("")).alias("name"), "seconds")


@query(_DELTAS_SQL + """, base AS (SELECT user_id, CAST(floor(sum(CAST(floor(value * 60) AS BIGINT)) / 3600) AS BIGINT) AS hours, count(*) FILTER (WHERE event_type = 'click') AS highlights FROM events GROUP BY user_id),
extra AS (SELECT user_id, sum(s) AS s, count(*) AS n FROM closed GROUP BY user_id)
SELECT user_id, CAST(hours + floor(coalesce(s, 0) / 3600) AS BIGINT) AS hours, greatest(0, highlights + CASE WHEN user_id % 2 = 0 THEN 1 ELSE -5 END) AS highlights FROM base LEFT JOIN extra USING (user_id)""")
def composed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Stored whole hours plus whole hours of what is not stored yet; counts never fall below 0."""
    base = table(spark, d, "events").groupBy("user_id").agg(F.floor(F.sum(F.floor(F.col("value") * 60).cast("long")) / 3600).cast("long").alias("hours"), F.count_if(F.col("event_type") == "click").alias("highlights"))
    extra = _closed(spark, d).groupBy("user_id").agg(F.sum("s").alias("s"))
    net = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-5)
    return base.join(extra, "user_id", "left").select("user_id", (F.col("hours") + F.floor(F.coalesce("s", F.lit(0)) / 3600)).cast("long").alias("hours"), F.greatest(F.lit(0).cast("long"), F.col("highlights") + net).alias("highlights"))


@query(_DELTAS_SQL + f""", base AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(sum(CAST(floor(value * 60) AS BIGINT)) / 60) AS BIGINT) AS minutes FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY ALL),
extra AS (SELECT user_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS day, sum(s) AS s FROM closed GROUP BY ALL)
SELECT user_id, day, CAST(minutes + floor(coalesce(s, 0) / 60) AS BIGINT) AS minutes, minutes + floor(coalesce(s, 0) / 60) >= {GOAL_MINUTES} AS goal_met, CAST(greatest(0, {GOAL_MINUTES} - (minutes + floor(coalesce(s, 0) / 60))) AS BIGINT) AS remaining FROM base LEFT JOIN extra USING (user_id, day)""")
def composed_mastery(spark: SparkSession, d: str) -> DataFrame:
    """Only days of the stored window gain minutes; goals are judged anew."""
    e = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
    base = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.floor(F.sum(F.floor(F.col("value") * 60).cast("long")) / 60).cast("long").alias("minutes"))
    extra = _closed(spark, d).groupBy("user_id", F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd").alias("day")).agg(F.sum("s").alias("s"))
    m = F.col("minutes") + F.floor(F.coalesce("s", F.lit(0)) / 60)
    return base.join(extra, ["user_id", "day"], "left").select("user_id", "day", m.cast("long").alias("minutes"), (m >= GOAL_MINUTES).alias("goal_met"), F.greatest(F.lit(0).cast("long"), (GOAL_MINUTES - m).cast("long")).alias("remaining"))


@query("""SELECT user_id, CAST(sum(s) AS BIGINT) AS seconds FROM (SELECT user_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT user_id, CAST(floor(value) AS BIGINT) FROM events WHERE event_id % 2 = 1) GROUP BY user_id""")
def segment_increment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stored = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 60).cast("long")).alias("seconds"))
    deltas = e.where("event_id % 2 = 1").select("user_id", F.floor("value").cast("long").alias("seconds"))
    return add_up(stored, deltas, ["user_id"], "seconds")


@query(f"""WITH j AS (SELECT event_id AS job, user_id AS book, (epoch_us(ts) // 1000) AS ms, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' ELSE 'READY' END AS status, event_id % 5 AS attempts FROM events),
e AS (SELECT * FROM j WHERE attempts < 3 AND (status IN ('PENDING', 'FAILED') OR (status = 'PROCESSING' AND ms < {NOW_MS} - 600000)))
SELECT book, job, status FROM e QUALIFY row_number() OVER (PARTITION BY book ORDER BY ms, job) = 1""")
def job_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that may run: pending, failed with attempts left, or stale; the oldest of each book."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "PENDING").when(kind == "view", "PROCESSING").when(kind == "error", "FAILED").otherwise("READY")
    jobs = table(spark, d, "events").select(F.col("event_id").alias("job"), F.col("user_id").alias("book"), millis(F.col("ts")).alias("ms"), status.alias("status"), (F.col("event_id") % 5).alias("attempts"))
    ready = jobs.where((F.col("attempts") < 3) & (F.col("status").isin("PENDING", "FAILED") | ((F.col("status") == "PROCESSING") & (F.col("ms") < NOW_MS - 600_000))))
    return top_per_group(ready, ["book"], [F.asc("ms"), F.asc("job")], 1).select("book", "job", "status")


@query(f"""WITH p AS (SELECT o_orderkey AS job, min(l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS runner, count(*) FILTER (WHERE l_returnflag <> 'R') AS claims FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT job, CASE WHEN o_orderstatus = 'O' AND runner IS NOT NULL THEN 'PROCESSING' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'DONE' END AS status, CASE WHEN o_orderstatus = 'O' THEN runner END AS claimed_by,
    CASE WHEN o_orderstatus = 'O' THEN greatest(claims - 1, 0) ELSE claims END AS lost FROM orders JOIN p ON job = o_orderkey""")
def job_claims(spark: SparkSession, d: str) -> DataFrame:
    """Compare and set: of the runners that want a pending job the first gets it, all others lose."""
    wanted = table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("job")).agg(F.min("l_linenumber").alias("runner"), F.count("*").alias("claims"))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderstatus") == "O").alias("pending")).join(wanted, "job", "left")
    claims = F.coalesce("claims", F.lit(0).cast("long"))
    status = F.when(F.col("pending") & F.col("runner").isNotNull(), "PROCESSING").when(F.col("pending"), "PENDING").otherwise("DONE")
    return jobs.select("job", status.alias("status"), F.when(F.col("pending"), F.col("runner")).alias("claimed_by"), F.when(F.col("pending"), F.greatest(claims - 1, F.lit(0).cast("long"))).otherwise(claims).alias("lost"))


@query(f"""WITH m AS (SELECT user_id, max((epoch_us(ts) // 1000)) AS ms FROM events GROUP BY 1)
SELECT user_id, ms >= {NOW_MS} - 90000 AS participant, ms < {NOW_MS} - 600000 AS stale, ms < {NOW_MS} - 3600000 AS orphan FROM m""")
def cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Who still takes part (90 s), what is stale (10 min) and what may be swept (1 h)."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(millis(F.col("ts"))).alias("ms"))
    return last.select("user_id", (F.col("ms") >= NOW_MS - 90_000).alias("participant"), (F.col("ms") < NOW_MS - 600_000).alias("stale"), (F.col("ms") < NOW_MS - 3_600_000).alias("orphan"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type) AS total FROM events)
SELECT event_id, CASE WHEN n = 1 THEN 'open' ELSE 'closed' END AS status, CASE WHEN n = 1 THEN total ELSE CAST(floor(value) AS BIGINT) END AS seconds FROM r""")
def close_superseded(spark: SparkSession, d: str) -> DataFrame:
    """An update from a ranking and from totals: of a key's sessions the newest stays open and takes over all seconds."""
    from pyspark.sql import Window as W

    key = W.partitionBy("user_id", "event_type")
    own = F.floor("value").cast("long")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", own.alias("own"))
    rows = rows.select("event_id", "own", (F.row_number().over(key.orderBy(F.desc("ts"), F.desc("event_id"))) == 1).alias("newest"), F.sum("own").over(key).alias("total"))
    return rows.select("event_id", F.when(F.col("newest"), "open").otherwise("closed").alias("status"), F.when(F.col("newest"), F.col("total")).otherwise(F.col("own")).alias("seconds"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS locator, max(event_id) AS at FROM events GROUP BY 1), s AS (SELECT user_id, arg_max(event_type, event_id) AS locator FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT l.user_id, l.locator, l.locator IS DISTINCT FROM s.locator AS dirty FROM l LEFT JOIN s ON l.user_id = s.user_id""")
def dirty_clear(spark: SparkSession, d: str) -> DataFrame:
    """A place that the server has acknowledged is clean only if it is still the local one."""
    e = table(spark, d, "events")
    sent = F.col("event_type") != "error"
    rows = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("locator"), F.max_by(F.when(sent, F.col("event_type")), F.when(sent, F.col("event_id"))).alias("acknowledged"))
    return rows.select("user_id", "locator", (~F.col("locator").eqNullSafe(F.col("acknowledged"))).alias("dirty"))
