"""Relational operators that the queries share: all take and return DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.sources.kept import kept

Order = Sequence[Column]


def top_per_group(df: DataFrame, by: Sequence[str], order: Order, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1. End `order` with a unique key."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, by: Sequence[str], order: Order, out: str) -> DataFrame:
    """The rows with their place (int, from 1) in their group, however large a group is: range partitions
    in order are written, and a row's place is that within its partition, after the group's rows in those
    before. End `order` with a unique key. Null groups are one group."""
    keys = [F.asc(c) for c in by]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = kept(ranged.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("seq_")), "ranges")
    # One row for each group and partition.
    sizes = rows.groupBy(*by, "part_").agg(F.count("*").alias("size_"), F.min("seq_").alias("first_"))
    before = F.coalesce(F.sum("size_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("part_").alias("of_part_"), (before - F.col("first_")).alias("shift_"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    met = rows.join(starts, [F.col("part_") == F.col("of_part_"), *same])
    return met.select(*df.columns, (F.col("seq_") + F.col("shift_") + 1).cast("int").alias(out))


def with_details(keys: DataFrame, details: DataFrame, on: Sequence[str]) -> DataFrame:
    """Late materialisation: the details of few keys, joined after they are chosen."""
    return keys.join(details, list(on), "left")


def counts_of_domain(df: DataFrame, by: Sequence[str], column: str, domain: Sequence[str]) -> DataFrame:
    """Counts by category, with zero for categories of the domain that don't occur."""
    one = [F.count_if(F.col(column) == v).alias(v) for v in domain]
    wide = df.groupBy(*by).agg(*one)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in domain])).alias("p")
    return wide.select(*by, pairs).select(*by, "p.*")


def first_seen(df: DataFrame, by: Sequence[str], array: str, out: str) -> DataFrame:
    """Case-insensitive dedupe of an array, the first spelling and the order kept."""
    placed = F.array_sort(F.transform(F.col(array), lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    rows = df.select(*by, placed.alias("sorted"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("sorted", lambda e: e["k"]))
    firsts = F.filter(F.zip_with("sorted", F.slice(before, F.lit(1), F.size("sorted")), lambda e, k: F.when(k.isNull() | (k != e["k"]), F.struct(e["i"].alias("i"), e["v"].alias("v")))), lambda e: e.isNotNull())
    return rows.select(*by, F.transform(F.array_sort(firsts), lambda e: e["v"]).alias(out))


def unique_names(df: DataFrame, by: Sequence[str], base: str, order: Order, out: str) -> DataFrame:
    """base, base-2, base-3 ... in each group, by `order`. Numbers whose name is some other
    row's base are skipped, so that all names of a group differ.

    One pass: of the bases of a group, those that read "base-number" are the numbers that
    base may not use; the k-th further row of a base gets the k-th free number.
    """
    bases = df.select(*by, base).distinct()
    parts = bases.select(*by, F.regexp_extract(base, r"^(.*)-([1-9]\d{0,17})$", 1).alias(base), F.regexp_extract(base, r"^(.*)-([1-9]\d{0,17})$", 2).try_cast("long").alias("number"))
    taken = parts.where("number > 1").groupBy(*by, base).agg(F.sort_array(F.collect_set("number")).alias("taken"))
    rows = df.withColumn("n", F.row_number().over(W.partitionBy(*by, base).orderBy(*order)).cast("long")).join(taken, [*by, base], "left")
    # The taken numbers are sorted: each that is not above the number reached so far moves it by one.
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("n"), lambda reached, number: reached + F.when(number <= reached, 1).otherwise(0))
    named = F.when(F.col("n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), free.cast("string")))
    return rows.withColumn(out, named).select(*df.columns, out)


# -- table changes: a new version of a table from the old one and a batch ------


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch replace those with equal keys; keys of a batch are unique."""
    return table.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)


def first_of_each(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row of each key, that with the smallest `order`."""
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("first")).select(*keys, "first.*")


def insert_if_absent(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.unionByName(batch.join(table.select(*keys), list(keys), "left_anti"))


def add_up(table: DataFrame, deltas: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds deltas to a value by key; new keys start from 0."""
    return table.select(*keys, value).unionByName(deltas.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def delete(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the batch's keys go; keys that don't exist change nothing."""
    return table.join(batch.select(*keys), list(keys), "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Partial patch: `has_<column>` tells a change to null from no change."""
    renamed = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], *[f"has_{c}" for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def replace_snapshot(local: DataFrame, server: DataFrame, key: str, local_only: Sequence[str], dirty: str, pending: Sequence[str]) -> DataFrame:
    """A full server snapshot replaces the local table. Local-only columns are carried
    over, and columns of pending intent keep the local value while the row is dirty."""
    old = local.select(key, F.col(dirty).alias("was_dirty"), *[F.col(c).alias(f"old_{c}") for c in [*local_only, *pending]])
    joined = server.join(old, key, "left")
    held = F.coalesce("was_dirty", F.lit(False))
    kept = [F.when(held, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in pending]
    rest = [c for c in server.columns if c not in pending]
    return joined.select(*rest, *kept, *[F.col(f"old_{c}").alias(c) for c in local_only], held.alias(dirty))
