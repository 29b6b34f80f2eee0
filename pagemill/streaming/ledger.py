"""A streaming sink that adds every session once, however often a batch or a session is sent.

    stream.writeStream.foreachBatch(Ledger(spark, folder).add).option("checkpointLocation", ...).start()

Each micro-batch writes its sessions to a folder of its own, and then its number to the
ledger, by a rename. A batch whose number is there is not taken again; one that failed before is written
anew over what it left. Of sessions with equal keys the first one counts, so the keys of a
batch are looked up among those of committed batches: only in the buckets that the batch has
keys in. Readers see committed batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.timing import split_by_day

#: Folders that the keys of a batch are dealt to.
BUCKETS = 64
KEYS = ["user_id", "client_key"]


class Ledger:
    """Sessions (user_id, client_key, start_ms, seconds, seq) by key; `seq` decides between equal keys of one batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers in the ledger."""
        path, store = self._path("ledger")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def sessions(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The sessions of all committed batches, or of some buckets of them."""
        if not (numbers := self.batches()):
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/batch={n}" for n in numbers])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def add(self, batch: DataFrame, number: int) -> None:
        if number in self.batches():
            return
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")
        first = batch.withColumn("rank", F.row_number().over(W.partitionBy(*KEYS).orderBy("seq", "start_ms", "seconds"))).where("rank = 1").drop("rank").withColumn("bucket", bucket)
        first = first.persist()
        try:
            wanted = [r.bucket for r in first.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            known = self.sessions(wanted)
            same = [first[k].eqNullSafe(known[k]) for k in KEYS] if known is not None else []
            fresh = first if known is None else first.join(known.select("bucket", *KEYS), [first["bucket"] == known["bucket"], *same], "left_anti")
            self._write(fresh, number)
        finally:
            first.unpersist()
        self._commit(number)

    def _write(self, fresh: DataFrame, number: int) -> None:
        columns = fresh.select(*KEYS, "start_ms", "seconds", "seq", "bucket")
        columns.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={number}")
        path, store = self._path("data", f"batch={number}")
        if not any(s.isDirectory() for s in store.listStatus(path)):  # a batch without fresh sessions has no folder of a bucket
            columns.withColumn("bucket", F.lit(0)).limit(0).write.mode("overwrite").parquet(f"{self.folder}/data/batch={number}/bucket=0")

    def _commit(self, number: int) -> None:
        ahead, store = self._path("ledger", f"_{number}")
        store.create(ahead, True).close()
        if not store.rename(ahead, self._path("ledger", str(number))[0]):
            raise RuntimeError(f"batch {number} could not be entered in the ledger")

    def totals(self) -> DataFrame:
        """Seconds by user and UTC day of start and of what follows midnight."""
        rows = self.sessions()
        if rows is None:
            return self.spark.createDataFrame([], "user_id long, day date, seconds long")
        spans = rows.select("user_id", F.explode(split_by_day(F.floor(F.col("start_ms") / 1000), F.col("seconds"))).alias("s"))
        return spans.groupBy("user_id", F.col("s.day").alias("day")).agg(F.sum("s.seconds").alias("seconds"))
