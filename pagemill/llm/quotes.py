"""Quotation linking for conversations, with DataFrame functions only.

The quote level of a line is the number of `>` in its prefix. Runs of lines of
one level are passages. The normalised runs and lines that a message quotes
are joined by hash to the first message of the conversation that says them
itself; its best such link is the message it replies to. Conversations come
back without quotes and with an order in which replies follow what they
answer, thread by thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written

PREFIX = r"^[> \t]*"


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def parse_quotes(messages: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """conv, turn, row (all columns), lines and runs: arrays of (level, text). A line
    without `>` in its prefix has level 0 and stays as it is."""
    prefix = lambda line: F.regexp_extract(line, PREFIX, 0)
    level = lambda line: F.length(prefix(line)) - F.length(F.replace(prefix(line), F.lit(">")))
    stripped = lambda line: F.when(level(line) > 0, F.regexp_replace(line, PREFIX, "")).otherwise(line)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda line: F.struct(level(line).alias("level"), stripped(line).alias("text")))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), lines.alias("lines"))
    at = lambda i: F.get(F.col("lines"), i)["level"]
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (at(i - 1) != at(i - 2)))
    rows = rows.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines") + 1)))
    run = lambda a, b: F.struct(at(a - 1).alias("level"), F.array_join(F.transform(F.slice("lines", a, b - a), lambda x: x["text"]), "\n").alias("text"))
    return rows.select("conv", "turn", "row", "lines", F.zip_with("starts", "ends", run).alias("runs"))


def _positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their positions, and the written table these are read from. Numbers the rows of each conversation from 0 by (thread, turn). The rows are
    range-partitioned, so that a conversation of any size is numbered by many
    tasks; each adds the rows that partitions before it hold."""
    keys = ["conv", "thread_turn", "turn"]
    placed = rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "placed")
    parts = placed.groupBy("conv", "part").agg(F.min("seq").alias("lo"), F.count("*").alias("c"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("conv2"), F.col("part").alias("part2"), "lo", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    numbered = placed.join(parts, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("part") == F.col("part2")))
    return numbered.withColumn("position", F.col("seq") - F.col("lo") + F.col("shift")).drop("conv2", "part2", "lo", "shift", "seq", "part"), placed


def _threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of all messages that reply to one, by pointer doubling."""
    state = written(parents.select("conv", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select(F.col("conv").alias("conv2"), F.col("turn").alias("turn2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        met = state.join(up, (F.col("conv") == F.col("conv2")) & (F.col("root") == F.col("turn2")), "left")
        moved = written(met.select("conv", "turn", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("root2").isNotNull().alias("moved")), "threads")
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Links messages to those they quote and orders each conversation by replies.

    A unit is a run of lines of one level, or one line, normalised, of at least
    `min_chars` characters. A unit's original is the smallest turn of the
    conversation that holds it at level 0. A message replies to one earlier
    turn: that of its links with the lowest quote level, then the longest unit,
    then the latest turn.

    Returns one row for each input row: row (all its columns, whatever their
    names), own_text (the level 0 lines, joined, blanks at both ends stripped),
    n_quoted (quoted runs), n_linked (distinct turns linked to), parent_turn
    (null: replies to none), thread_turn (the turn at the end of its parents),
    depth (its distance, from 0) and position (from 0 in the conversation, by
    thread_turn, then turn: replies follow what they answer). Rows that repeat
    a conversation and turn share their links and have neighbouring positions.
    Rows with a null conversation or turn link to nothing; the null conversation
    is one conversation, and null turns come first. Null and empty texts quote nothing.
    """
    with scratch(messages.sparkSession) as keep:
        parsed = parse_quotes(messages, conv_col, turn_col, text_col)
        units = parsed.select("conv", "turn", F.explode(F.concat("runs", "lines")).alias("u")).select("conv", "turn", "u.level", normalised(F.col("u.text")).alias("t"))
        units = units.where(F.length("t") >= min_chars).select("conv", "turn", "level", F.md5(F.col("t").cast("binary")).alias("key"), F.length("t").alias("size"))
        quoted = written(units.where("level > 0").distinct(), "quoted")
        # Only what somebody quotes can be an original; an equal unit is looked for once a conversation.
        said = units.where("level = 0").join(quoted.select("conv", "key").distinct(), ["conv", "key"], "left_semi")
        originals = said.groupBy("conv", "key").agg(F.min("turn").alias("original"))
        links = quoted.join(originals, ["conv", "key"]).where("original < turn")
        best = F.max(F.struct((-F.col("level")).alias("near"), "size", "original"))
        parents = written(links.groupBy("conv", "turn").agg(best.getField("original").alias("parent_turn"), F.count_distinct("original").alias("n_linked")), "parents")
        threads = parents.join(_threads(parents), ["conv", "turn"])
        own = F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n"), F.lit(" \t\n\r"))
        rows = parsed.select("conv", "turn", "row", own.alias("own_text"), F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("long").alias("n_quoted"))
        rows = rows.join(threads, ["conv", "turn"], "left").withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "thread_turn": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0))})
        numbered, placed = _positions(rows.drop("root"))
        keep(placed)
    return numbered.select("row", "own_text", "n_quoted", "n_linked", "parent_turn", "thread_turn", "depth", "position")
