"""Change logs: pending edits over a stored snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coalesced(log: DataFrame, key: str, seq: str) -> DataFrame:
    """One pending change a key, the newest, at the place of its last queuing."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("c")).select(key, "c.*")


def merged(snapshot: DataFrame, log: DataFrame, key: str, seq: str, op: str, columns: list[str]) -> DataFrame:
    """The snapshot with pending changes on top: newest change wins, deletes remove."""
    pending = coalesced(log, key, seq)
    kept = snapshot.select(key, *columns).join(pending.select(key), key, "left_anti").withColumn("pending", F.lit(False))
    return kept.unionByName(pending.where(F.col(op) != "delete").select(key, *columns).withColumn("pending", F.lit(True)))


def sendable(log: DataFrame, snapshot: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """What is left to send: a delete of something that was never stored cancels silently."""
    pending = coalesced(log, key, seq)
    unknown = pending.where(F.col(op) == "delete").join(snapshot.select(key), key, "left_anti").select(key)
    return pending.join(unknown, key, "left_anti")


def drained(queue: DataFrame, by: str, seq: str, outcome: Column) -> DataFrame:
    """A first-in-first-out queue: `retry` blocks all that follow it, others move on."""
    before = W.partitionBy(by).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    rows = queue.withColumn("outcome", outcome)
    blocked = F.coalesce(F.max((F.col("outcome") == "retry").cast("int")).over(before), F.lit(0)) == 1
    return rows.withColumn("state", F.when(blocked, "waiting").otherwise(F.col("outcome")))


def last_write(events: DataFrame, key: str, at: Column, seq: Column, values: list[str]) -> DataFrame:
    """The most recent write wins; of equal times the one that came later."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at.alias("at"), seq.alias("seq"))).alias("w")).select(key, "w.*")


def dirty_merge(server: DataFrame, local: DataFrame, key: str, fields: list[str], dirty: str) -> DataFrame:
    """Field by field: a field that the local row names as dirty keeps the local value."""
    mine = local.select(key, F.col(dirty).alias("dirty_fields"), *[F.col(f).alias(f"local_{f}") for f in fields])
    joined = server.join(mine, key, "left")
    kept = [F.when(F.coalesce(F.array_contains("dirty_fields", f), F.lit(False)), F.col(f"local_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return joined.select(key, *kept)
