"""Joins of intervals that overlap, by bins: no pair of rows meets that shares no bin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_starts(sizes: pa.Array) -> pa.Array:
    """Where each part of a list begins, if parts of these sizes follow one another with one unit between them."""
    flat = sizes.flatten().to_numpy(zero_copy_only=False) + 1
    ends = np.r_[0, np.cumsum(sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    before = np.cumsum(flat) - flat
    starts = before - np.repeat(np.r_[before, 0][ends[:-1]], np.diff(ends)) if len(flat) else flat
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(starts, pa.int64()))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], bounds: tuple[str, str], other: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows with equal `by` columns (nulls meet nothing) whose half-open intervals overlap.

    `bounds` and `other` name the whole-number bounds of the left and the right intervals. Each
    interval is put into the bins of `width` that it touches, and a pair is given in the first bin that
    both touch, so that it comes once however many bins they share. Choose a width about that of
    the shorter intervals. Empty intervals and null bounds overlap nothing. Column names must differ, but for `by`.
    """

    def binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
        full = df.where(F.col(lo) < F.col(hi))
        return full.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))

    (lo, hi), (lo2, hi2) = bounds, other
    pairs = binned(left, lo, hi).join(binned(right, lo2, hi2), [*by, "bin_"])
    first = F.col("bin_") == F.floor(F.greatest(lo, lo2) / width)
    return pairs.where(first & (F.col(lo) < F.col(hi2)) & (F.col(lo2) < F.col(hi))).drop("bin_")
