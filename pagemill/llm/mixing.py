"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (one for each combination of source, language
and topic). The cells' token weights are raked to the target share of each
category of each dimension in turn, until all margins hold. A document is then
kept with its cell's calibrated probability, so that the expected tokens of the
sample have the target margins.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written

#: Up to this many cells (some MB) one task rakes them all and the cell table is broadcast to
#: the documents; larger ones are raked by shuffles and joined by key. Both give the same rows.
BROADCAST_CELLS = 50_000
#: Rounds that one job rakes before its weights are written.
ROUNDS_A_JOB = 5
#: Margins hold when none is off by more than this share of its aim.
TOLERANCE = 1e-6
#: Raking has stalled when two jobs in a row bring the largest error no lower than this share of the least so far.
STALLED = 0.99

#: A dimension's target: shares by category, or an exponent that tempers the present shares.
Target = Mapping[str, float] | float


def word_count(text: str | Column) -> Column:
    """Words: runs without U+0020 and U+0009 to U+000D. Null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_topic(text: str | Column) -> Column:
    """A coarse topic, where a table has none: legal (names a licence), brief (under 1,000 characters) or prose."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.contains(F.lower(col), F.lit("license")), "legal").when(F.length(col) < 1000, "brief").otherwise("prose")


def _raked(weights: DataFrame, names: list[str], rounds: int, most: float | None, small: bool) -> DataFrame:
    """The weights after so many more rounds, written. A small table is one partition, so
    that its windows need no shuffle."""
    weights = weights.coalesce(1) if small else weights
    for _ in range(rounds):
        for n in names:
            margin = F.sum("weight").over(W.partitionBy(n))
            moved = F.coalesce(F.try_divide(F.col("weight") * F.col(f"aim_{n}"), margin), F.lit(0.0))
            weights = weights.withColumn("weight", moved if most is None else F.least(moved, F.col("tokens") * float(most)))
    return written(weights, "raked")


def _margin_errors(weights: DataFrame, names: list[str]) -> list[Row]:
    """The margins with the largest relative errors, largest first."""
    margins = [weights.groupBy(F.col(n).alias("category")).agg(F.sum("weight").alias("reached"), F.max(f"aim_{n}").alias("aim")).withColumn("dimension", F.lit(n)) for n in names]
    error = F.when(F.col("aim") > 0, F.abs(F.col("reached") - F.col("aim")) / F.col("aim")).otherwise(F.lit(0.0))
    return reduce(DataFrame.union, margins).withColumn("error", error).orderBy(F.desc("error"), "dimension", "category").limit(5).collect()


def raked_cells(docs: DataFrame, dimensions: Mapping[str, tuple[Column, Target]], tokens: Column, rounds: int = 15, most: float | None = None) -> DataFrame:
    """The cells with tokens, weight (raked tokens, their sum that of all tokens) and
    probability (weight / tokens, divided by its largest value).

    With `most`, no cell may weigh more than so many times its tokens: the other cells
    of its margins take over what it can't give, and at least 1 / `most` of all
    tokens can be expected to stay, however short one cell is of its target.

    After `rounds` rounds raking goes on until the largest relative error of a
    margin is at most TOLERANCE. Where it stalls before (the targets contradict
    each other), a warning names the error and the margins that are farthest off."""
    names = list(dimensions)
    cells = docs.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, (c, _) in dimensions.items()], tokens.alias("tokens"))
    cells = written(cells.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "cells", few=True)
    small = cells.count() <= BROADCAST_CELLS
    everything = W.partitionBy(F.lit(1))
    aimed = cells.where("tokens > 0")
    for n, (_, target) in dimensions.items():
        if isinstance(target, Mapping):
            share = F.lit(0.0)
            for category, value in target.items():
                share = F.when(F.col(n) == category, float(value)).otherwise(share)
            sizes = cells.where("tokens > 0").groupBy(n).agg(F.sum("tokens").alias("size")).withColumn("raw", share)
        else:
            sizes = cells.where("tokens > 0").groupBy(n).agg(F.sum("tokens").alias("size")).withColumn("raw", F.pow(F.col("size").cast("double"), F.lit(float(target))))
        # One row a category: the total of the shares is taken over those that occur.
        aims = sizes.select(n, (F.col("raw") / F.sum("raw").over(everything) * F.sum("size").over(everything)).alias(f"aim_{n}"))
        aimed = aimed.join(aims, n)
    weights = aimed.withColumn("weight", F.col("tokens").cast("double"))
    for done in range(0, rounds, ROUNDS_A_JOB):
        weights = _raked(weights, names, min(ROUNDS_A_JOB, rounds - done), most, small)
    least, idle, off = float("inf"), 0, _margin_errors(weights, names)
    while off and off[0].error > TOLERANCE:
        idle = 0 if off[0].error < STALLED * least else idle + 1
        if idle == 2:
            worst = "; ".join(f"{r.dimension} {r.category!r}: {r.reached:.6g} of {r.aim:.6g} tokens" for r in off)
            warnings.warn(f"The targets of the mix can't all be met: raking stalled at a relative margin error of {off[0].error:.3g} ({worst})", stacklevel=2)
            break
        least = min(least, off[0].error)
        weights = _raked(weights, names, ROUNDS_A_JOB, most, small)
        off = _margin_errors(weights, names)
    largest = weights.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] or 1.0
    return weights.select(*names, "tokens", "documents", "weight", (F.col("weight") / F.col("tokens") / largest).alias("probability"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52


def mix(docs: DataFrame, dimensions: Mapping[str, tuple[Column, Target]], tokens: Column, id_col: str = "doc_id", rounds: int = 15, most: float | None = None, seed: int = 7) -> DataFrame:
    """Tells for each document whether the calibrated sample holds it.

    `dimensions` names each dimension's column and target. Shares are taken over
    the categories that occur; a category without a share gets weight 0. Null
    categories are one category, the empty one. `most` bounds the weights as
    `raked_cells` says. No document is repeated.

    Returns one row for each input row: row (all its columns, whatever their
    names), tokens, probability and kept. A document without tokens has no
    weight of its own and is kept with its cell's probability, or dropped where the
    cell has no tokens at all. Decisions depend on id and seed only: rows that
    repeat an id in a cell share their fate, and so do rows with a null id.
    """
    names = list(dimensions)
    with scratch(docs.sparkSession) as keep:
        cells = written(raked_cells(docs, dimensions, tokens, rounds, most).select(*[F.col(n).alias(f"cell_{n}") for n in names], "probability"), "probabilities", few=True)
        keep(cells)
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tokens.alias("tokens"), *[F.coalesce(c.cast("string"), F.lit("")).alias(f"cell_{n}") for n, (c, _) in dimensions.items()])
    out = keyed.join(cells, [f"cell_{n}" for n in names], "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.select("row", "tokens", "probability", (uniform(F.col(f"row.{id_col}"), seed) < F.col("probability")).alias("kept"))
