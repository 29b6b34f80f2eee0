"""MinHash near-duplicate detection with SuperMinHash signatures.

SuperMinHash gives every element of a set a random permutation of the
registers and lets it offer rank + uniform to the register of each rank. A
round offers one rank for all elements; since later ranks offer larger values,
the rounds stop as soon as every register holds less than the next rank. Texts
of a few hundred shingles need one or two rounds of the hundred.

Equal sets are one class and are sketched into buckets once. The sets of all
members of buckets are written once, as hash arrays; links are confirmed on
these and grouped by union-find. In a bucket (members that share a band of the
signature) each member is compared with one centre, not with all others. Where
a bucket still holds several components, the shingles that a member has in
common with any other component bound its similarity to them; most members can
be settled by that. What remains is compared, in blocks, until every pair of
members that could join two components has been compared, so that no link of
a bucket is lost and a group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bounded, scratch, utf8, written
from .components import components

#: Bytes of word hashes that a task holds; of output rows that it hands on at once.
WORD_BYTES, BATCH_BYTES = 24 << 20, 8 << 20
#: Rounds in which the members of a bucket are compared with one centre, before all that is left is compared.
STAR_ROUNDS = 2
#: Groups of shingles whose common sizes bound what two sets share.
GROUPS = 64
#: Members of a bucket, about, that one block holds when all that is left is compared.
BLOCK_ROWS = 256
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingles(text: bytes, size: int, known: Bounded | None = None) -> np.ndarray:
    """The distinct hashed shingles of `size` words, sorted. Words are runs without
    U+0020 and U+0009 to U+000D, A-Z lower-cased. Fewer words than `size` are one
    shingle, no words are none. `known` is a cache of word hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_word if known is None else known.__getitem__, words), np.uint64, len(words))
    if len(w) < size:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = _mix(h * _STEP + x)
        return h
    h = w[: len(w) - size + 1]
    for j in range(1, size):
        h = _mix(h + _STEP) + w[j : len(w) - size + 1 + j]
    return np.unique(_mix(h))


def _digest(shingled: np.ndarray) -> bytes:
    return blake2b(shingled.tobytes(), digest_size=16).digest()


def superminhash(elements: np.ndarray, registers: int) -> np.ndarray:
    """The signature of a set of distinct hashes (at most 256 registers)."""
    values = np.full(registers, np.inf)
    order = rows = None
    for rank in range(registers):
        draw = _mix(elements + np.array([2 * rank + 1], np.uint64) * _STEP)
        uniform = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = rank + (_mix(draw + _STEP) % np.uint64(registers - rank)).astype(np.int64)
        if rank == 0:
            first = register = pick
        else:
            if order is None:
                rows = np.arange(len(elements))
                order = np.tile(np.arange(registers, dtype=np.uint8), (len(elements), 1))
                order[rows, first], order[rows, 0] = 0, first
            register = order[rows, pick]
            order[rows, pick] = order[:, rank]
            order[:, rank] = register
        np.minimum.at(values, register, uniform + rank)
        if values.max() < rank + 1:
            break
    return values


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of `rows` registers."""
    parts = signature.view(np.uint64).reshape(-1, rows)
    h = np.arange(len(parts), dtype=np.uint64)
    for k in range(rows):
        h = _mix(h * _STEP + parts[:, k])
    return h.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int, n_bands: int, rows: int) -> DataFrame:
    """(id, n, k1, k2, bands): the size and digest of each row's set. A task sketches
    each set once: bands are null where it has met the set before, for empty sets
    and for rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = Bounded(_hash_word, WORD_BYTES), set()
        for batch in batches:
            n, keys, found = [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                s = shingles(text.as_py(), size, known)
                n.append(len(s))
                keys.append(_digest(s))
                fresh = len(s) and key.is_valid and keys[-1] not in met
                if fresh:
                    met.add(keys[-1])
                found.append(bands(superminhash(s, n_bands * rows), rows) if fresh else None)
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            ends = np.cumsum([0] + [0 if b is None else n_bands for b in found])
            flat = np.concatenate([b for b in found if b is not None] or [np.empty(0, np.int64)])
            none = np.array([b is None for b in found], bool)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists], ["id", "n", "k1", "k2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows_in = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return rows_in.mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, s): the sorted shingle hashes of the wanted (id, k1, k2, rep). A text of
    another digest, where an id repeats, is left out; equal rows are given once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = Bounded(_hash_word, WORD_BYTES), set()

        def packed(reps: pa.Array, at: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(s) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([reps.take(pa.array(at, pa.int64())), lists], ["rep", "s"])

        for batch in batches:
            at, sets, held = [], [], 0
            for i, (k1, k2, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)), batch.column(3))):
                if (k1, k2) in met:
                    continue
                s = shingles(text.as_py(), size, known)
                if tuple(np.frombuffer(_digest(s), "<i8")) != (k1, k2):
                    continue
                met.add((k1, k2))
                at.append(i)
                sets.append(s)
                held += s.nbytes
                if held >= BATCH_BYTES:
                    yield packed(batch.column(0), at, sets)
                    at, sets, held = [], [], 0
            if at:
                yield packed(batch.column(0), at, sets)

    kind = wanted.schema["rep"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(wanted, "id")
    return rows.select("rep", "k1", "k2", "text").mapInArrow(run, f"rep {kind}, s array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    met = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    common, both = F.size(F.array_intersect("x", "y")).cast("long"), F.size("x").cast("long") + F.size("y")
    return met.where(common * share[1] >= (both - common) * share[0]).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (80, 100), n_bands: int = 28, rows: int = 4) -> DataFrame:
    """Groups of near copies: the components of the documents linked by a Jaccard
    similarity of shingle sets of at least share[0] / share[1].

    Returns one row for each distinct id: id, n_shingles, component_id (the
    smallest id that links lead to, the own one included) and kept (whether
    that is the own id). Null and empty texts have no shingles and no links.
    Every row with a null id is a row of its own, linked with nothing: its
    component_id is null, and it is kept. Rows that repeat an id are one document,
    with the text whose set digest is smallest. Texts of any length are
    compared whole; other columns are not read.

    A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^n_bands:
    with 28 bands of 4 rows, 1 - 4e-7 at 0.8 and 1 - 1e-9 at 0.85. Documents
    of equal sets always meet.
    """

    def near(common: Column) -> Column:
        """Whether two sets with at most so many common elements can be similar enough."""
        return common * sum(share) >= (F.col("n") + F.col("n2")) * share[0]

    with scratch(docs.sparkSession) as keep:
        sketches = written(_sketches(docs, id_col, text_col, words, n_bands, rows).withColumn("at", F.monotonically_increasing_id()), "sketches")
        members = sketches.where("id is not null").groupBy("id").agg(F.min(F.struct("k1", "k2", "n")).alias("s")).select("id", "s.*")
        # Of the rows that hold a set's bands, one: its id leads to the text, rep is the smallest id with the set.
        carriers = sketches.where("bands is not null").groupBy("k1", "k2").agg(F.min("at").alias("at"))
        # Written, so that a class of very many copies can be split where members meet their class.
        classes = written(members.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep")).join(carriers, ["k1", "k2"]), "classes", few=True)
        sketched = sketches.where("bands is not null").join(classes, ["k1", "k2", "at"])
        in_bands = sketched.select("rep", "n", F.explode("bands").alias("h"))
        crowds = written(in_bands.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "crowds", few=True)
        crowded = written(in_bands.join(crowds, "h"), "crowded")
        wanted = sketched.select("id", "k1", "k2", "rep").join(crowded.select("rep").distinct(), "rep", "left_semi")
        sets = written(_sets(docs, id_col, text_col, wanted, words), "sets")

        done, labels, left = [], None, crowded
        for turn in range(STAR_ROUNDS + 1):
            if labels is None:
                rows_now = crowded.withColumns({"root": F.col("rep"), "m": F.col("n"), "groups": F.lit(None).cast("array<int>")})
            else:
                labelled = left.drop("root").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
                rows_now = mixed = written(_mixed(labelled), "mixed")
                if mixed.isEmpty():
                    break
            if turn == 1:
                # Components only grow, so that what a member shares with others only
                # shrinks: these bounds and the rows they settle hold for later rounds.
                supported = written(mixed.join(_support(mixed, sets), "rep"), "supported", few=True)
                least = written(supported.groupBy("h").agg(F.min("n").alias("n_least")), "least", few=True)
                alive = supported.join(least, "h").where(F.col("m") * sum(share) >= (F.col("n") + F.col("n_least")) * share[0]).drop("n_least")
                rows_now = left = written(_mixed(alive), "alive")
                if rows_now.isEmpty():
                    break
            met = _with_centres(rows_now, turn) if turn < STAR_ROUNDS else _in_blocks(rows_now)
            met = met.where(F.col("root") != F.col("root2")).where(near(F.least("m", "m2")))
            if labels is not None:
                met = met.where(near(F.aggregate(F.zip_with("groups", "groups2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)))
            pairs = met.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()
            if done:
                pairs = pairs.join(reduce(DataFrame.union, done), ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs", few=True)
            done.append(pairs)
            found = written(_confirmed(pairs, sets, share), "links", few=True)
            if labels is None:
                labels = components(found)
            elif not found.isEmpty():
                labels = components(found.union(labels.select("node", "root")))
        keep(sketches, classes, labels)
    named = members.join(classes.drop("at"), ["k1", "k2"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "id")
    named = named.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    return named.unionByName(sketches.where("id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


_COLUMNS = ["rep", "n", "root", "m", "groups"]


def _with_centres(rows: DataFrame, turn: int) -> DataFrame:
    """Each row of a bucket beside the bucket's centre of this turn. The centres are
    written, so that Spark can split a large bucket where its rows meet them."""
    ranked = F.struct(F.xxhash64(F.lit(turn), "rep").alias("r"), F.struct(*_COLUMNS).alias("v"))
    centres = written(rows.groupBy("h").agg(F.min(ranked).alias("c")).select("h", "c.v.*"), "centres", few=True)
    return rows.join(centres.toDF("h", *[f"{c}2" for c in _COLUMNS]), "h")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Every pair of rows of a bucket, once. A bucket is dealt to blocks, and each two
    blocks meet under a key of their own."""
    sizes = written(rows.groupBy("h").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "sizes", few=True)
    dealt = rows.join(sizes, "h").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    first = dealt.select("*", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other")).select("h", F.col("block").alias("p"), F.col("other").alias("q"), *_COLUMNS)
    second = dealt.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("other")).select("h", F.col("other").alias("p"), F.col("block").alias("q"), *[F.col(c).alias(f"{c}2") for c in _COLUMNS])
    return first.join(second, ["h", "p", "q"]).where((F.col("p") < F.col("q")) | (F.col("rep") < F.col("rep2")))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components."""
    several = written(rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"), "several", few=True)
    return rows.join(several, "h")


def _support(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, m, groups): how many shingles of each member stand in another component
    too, in all and by GROUPS groups of shingles. No two components can have a
    more similar pair than the smaller of two members' numbers allow."""
    known = rows.select("rep", "root").distinct()
    each = written(known.join(sets, "rep").select("rep", "root", F.explode("s").alias("s")), "support", few=True)
    shared = written(each.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s"), "shared", few=True)
    counted = each.join(shared, "s").groupBy("rep", F.pmod(F.shiftright("s", 7), F.lit(GROUPS)).cast("int").alias("g")).agg(F.count("*").cast("int").alias("c"))
    by_group = F.map_from_entries(F.collect_list(F.struct("g", "c")))
    counted = counted.groupBy("rep").agg(F.sum("c").alias("m"), by_group.alias("by"))
    return counted.select("rep", "m", F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.coalesce(F.try_element_at("by", g), F.lit(0))).alias("groups"))
