"""Reading sessions from events of several devices, as window expressions.

Time between two events of a key counts only if a device was active before the
later one: its last event was no stop and at most `idle_ms` old. That state is
the running maximum of what each event covers, so no sequential pass is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.timing import elapsed_seconds, millis, split_by_day

FOREVER = 2**62


def accrue(events: DataFrame, key: str, device: str, ts: str, seq: str, is_stop: Column, idle_ms: int) -> DataFrame:
    """Adds ms, prev_ms, active_before and elapsed (seconds) to every event of one session."""
    rows = events.withColumn("ms", millis(F.col(ts)))
    own = W.partitionBy(key, device).orderBy("ms", seq)
    all_ = W.partitionBy(key).orderBy("ms", seq)
    ends = F.when(~is_stop, F.least(F.col("ms") + idle_ms, F.coalesce(F.lead("ms").over(own), F.lit(FOREVER))))
    rows = rows.withColumn("covers", ends).withColumn("prev_ms", F.lag("ms").over(all_))
    covered = F.max("covers").over(all_.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("active_before", F.coalesce(covered >= F.col("ms"), F.lit(False)))
    return rows.withColumn("elapsed", F.when(F.col("active_before"), elapsed_seconds(F.col("prev_ms"), F.col("ms"))).otherwise(0).cast("long")).drop("covers")


def day_segments(accrued: DataFrame, key: str) -> DataFrame:
    """Seconds by key and UTC day; a span over midnight belongs to both days."""
    spans = accrued.where("elapsed > 0").select(key, F.explode(split_by_day(F.floor(F.col("prev_ms") / 1000), F.col("elapsed"))).alias("s"))
    return spans.groupBy(key, F.col("s.day").alias("day")).agg(F.sum("s.seconds").alias("seconds"))


def replayed(sessions: DataFrame, keys: list[str], start_ms: str, end_ms: str, seq: str, most: int = 86_400) -> DataFrame:
    """Offline sessions, replayed: invalid spans are dropped, the first one of a key wins,
    and durations are clamped to `most` seconds."""
    valid = sessions.where(F.col(end_ms) >= F.col(start_ms))
    first = valid.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(seq))).where("n = 1").drop("n")
    asked = elapsed_seconds(F.col(start_ms), F.col(end_ms))
    return first.withColumns({"requested": asked, "seconds": F.least(asked, F.lit(most).cast("long")), "clamped": asked > most})
