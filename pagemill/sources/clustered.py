"""Tables laid out for range reads: range-partitioned and sorted by a key, with the bounds of each file beside them.

A read by key range opens the files whose bounds overlap the range, and in these Parquet's own
statistics skip row groups and pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A read by more files than this takes the whole folder instead of naming each.
MOST_FILES = 10_000
#: Rows of a page.
PAGE_ROWS = 1_000


@dataclass(frozen=True)
class Clustered:
    """A table below `folder`, sorted by `keys`."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]

    @property
    def bounds(self) -> DataFrame:
        """One row a file: file, rows, and lo_ and hi_ of each key (null where a file holds only nulls)."""
        return self.spark.read.parquet(f"{self.folder}/bounds")

    def files(self, **ranges: tuple) -> list[str] | None:
        """The files that can hold rows of the ranges (from, to, both included), or None where they are too many to name."""
        fits = F.lit(True)
        for key, (lo, hi) in ranges.items():
            fits = fits & (F.col(f"lo_{key}") <= _value(hi)) & (F.col(f"hi_{key}") >= _value(lo))
        found = self.bounds.where(fits).select("file").limit(MOST_FILES + 1).collect()
        return [r.file for r in found] if len(found) <= MOST_FILES else None

    def read(self, **ranges: tuple) -> DataFrame:
        """The rows whose keys lie in the ranges, both ends included; null keys lie in none."""
        for key in ranges:
            if key not in self.keys:
                raise ValueError(f"the table is not sorted by {key!r}")
        files = self.files(**ranges)
        whole = self.spark.read.parquet(f"{self.folder}/rows")
        rows = whole if files is None else whole.limit(0) if not files else self.spark.read.schema(whole.schema).parquet(*files)
        for key, (lo, hi) in ranges.items():
            rows = rows.where(F.col(key).between(_value(lo), _value(hi)))
        return rows


def _value(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def write_clustered(rows: DataFrame, keys: list[str], folder: str, files: int | None = None) -> Clustered:
    """Writes `rows` sorted by `keys` to about `files` files (else as many as Spark finds fit). Rows with equal
    keys may stand in two files."""
    spark = rows.sparkSession
    # A number beside the keys parts the rows of a hot key among files, too.
    dealt = rows.withColumn("n_", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(files, *keys, "n_") if files else dealt.repartitionByRange(*keys, "n_")
    ranged.sortWithinPartitions(*keys, "n_").drop("n_").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/rows")
    back = spark.read.parquet(f"{folder}/rows").select(F.col("_metadata.file_path").alias("file"), *keys)
    limits = [f(k).alias(f"{name}_{k}") for k in keys for f, name in ((F.min, "lo"), (F.max, "hi"))]
    back.groupBy("file").agg(F.count("*").alias("rows"), *limits).coalesce(1).write.parquet(f"{folder}/bounds")
    return Clustered(spark, folder, tuple(keys))
