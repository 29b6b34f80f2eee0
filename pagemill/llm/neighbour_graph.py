"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search reads it.

Vectors become unit vectors with one component more, of which the inner product
with a query keeps the order, in one byte a component. Blocks of vectors that
lie on the same sides of random planes give each node first links. Then a
neighbour of a neighbour is likely to be a neighbour: in each round every node
gathers a sample of its links from both ends, compares those with one another
where one is fresh, and the pairs that improve a list are merged into it, until
few lists change. A search starts at the query's own node (or at seeds), and in
each round opens the best nodes of its pool that are still closed, until
none is. All rounds are joins; what a node sends or gathers is bounded by the
size of lists and samples, however many lists a node is in. The pool's best are scored
exactly on the original vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, scratch, written
from .top_k import _distinct

#: Links of a node, and how many fresh and as many old ones of those that lead to a node are compared in a round.
LINKS, SAMPLE = 32, 16
#: Building ends when no more than this share of all links is fresh.
FEW = 0.02
#: Orders by random planes that give first links; vectors of a block of one, and the links it gives to each.
TREES, BLOCK, NAMED = 4, 256, 12
#: Vectors of a block of one more order, a random one: all are linked, so that distant groups keep some link.
RANDOM_BLOCK = 16
#: Rows that a task gets in the first step.
TASK_ROWS = 20_000
#: Entries of a search's pool, and how many closed ones it opens in a round.
POOL, OPENED = 256, 64
#: Nodes at which searches for unknown vectors start: the best ENTRIES of SEEDS.
SEEDS, ENTRIES = 256, 8

_LINK = "struct<d:float,node:long,fresh:boolean>"


def usable(vector: Column) -> Column:
    """The vector as doubles; null where it is null, zero, or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.when(vector.isNotNull() & fine, x)


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, added up from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# Small vectors: bytes and a scale -----------------------------------------------------------------


def _bytes(z: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    top = np.abs(z).max(1, initial=0)
    top[top == 0] = 1
    return [r.tobytes() for r in np.rint(z * (127 / top)[:, None]).astype(np.int8)], (top / 127).astype(np.float32)


def _small(values: list, size: tuple[float, float], of_query: bool) -> tuple[list[bytes], np.ndarray]:
    """Node vectors have length 1 by one component more, queries by scaling."""
    codes, scales = [b""] * len(values), np.zeros(len(values), np.float32)
    lengths = np.array([len(v) for v in values])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        y = np.array([values[i] for i in own], float).reshape(len(own), length) / size[0] / size[1]
        norms = np.sqrt((y * y).sum(1))
        if of_query:
            z = np.c_[y / np.where(norms > 0, norms, 1)[:, None], np.zeros(len(y))]
        else:
            z = np.c_[y, np.sqrt(np.maximum(0, 1 - norms**2))]
        found, scales[own] = _bytes(z)
        for i, code in zip(own, found):
            codes[i] = code
    return codes, scales


def _size(nodes: DataFrame) -> tuple[float, float]:
    """The largest component, and the largest length of the vectors divided by it."""
    top = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    scaled = F.transform("v", lambda x: x / top)
    return top, nodes.agg(F.max(F.sqrt(inner_product(scaled, scaled)))).first()[0] or 1.0


def _rows(codes: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the codes, one after the other, and where each begins."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.int8), np.r_[0, np.cumsum(lengths)]


def _distances(a: np.ndarray, b: np.ndarray, scale_a: np.ndarray, scale_b: np.ndarray) -> np.ndarray:
    """Negative products of rows of bytes: the same for a pair wherever it is met, since the sums are whole numbers."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    dots = a.astype(kind) @ b.astype(kind).T
    return -(dots.astype(np.float32) * (scale_a[:, None] * scale_b[None, :]))


def _table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names)


# Lists of links, and pools of searches ---------------------------------------------------------------


def _merged(links: Column, found: Column, most: int) -> Column:
    """The best `most` of (d, node, fresh) links and (d, node) pairs; pairs that are not links yet are fresh ones."""
    fresh = F.transform(found, lambda e: F.struct(e["d"].alias("d"), e["node"].alias("node"), F.lit(True).alias("fresh")))
    # Entries for one node are equal but for `fresh`, so that they are neighbours, and false comes first.
    single = lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["node"] != e["node"]))
    return F.transform(F.array(F.sort_array(F.concat(links, fresh))), lambda s: F.slice(single(s), 1, most))[0]


def _last(links: Column, most: int) -> Column:
    """What a new entry must undercut."""
    return F.when(F.size(links) >= most, F.element_at(links, -1)["d"]).otherwise(F.lit(float("inf")).cast("float"))


# Building --------------------------------------------------------------------------------------------


def _first_pairs(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """(a, b, d): the nearest ones of blocks of nodes that are next to each other in some order."""

    def signs(codes: pa.Array, lengths: pa.Array, node: pa.Array) -> pa.Array:
        lengths = lengths.to_numpy(zero_copy_only=False)
        out = np.zeros((len(codes), TREES + 1), np.int64)
        flat, at = _rows(codes, lengths)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            planes = np.random.default_rng([seed, int(length)]).normal(size=(int(length), TREES * 32))
            x = np.array([flat[at[i] : at[i] + length] for i in own], np.float32)
            sides = (x @ planes.astype(np.float32) > 0).reshape(len(own), TREES, 32)
            out[own, :TREES] = (sides * (1 << np.arange(31, -1, -1, dtype=np.int64))).sum(2)
        mixed = (node.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, TREES] = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(2)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * (TREES + 1), pa.int32()), pa.array(out.ravel()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs() -> pa.RecordBatch:
            ids = np.array([r[2] for r in held])
            x, scales = np.frombuffer(b"".join(r[3] for r in held), np.int8).reshape(len(held), -1), np.array([r[4] for r in held], np.float32)
            d = _distances(x, x, scales, scales)
            np.fill_diagonal(d, np.inf)
            n = min(NAMED if held[0][1] < TREES else RANDOM_BLOCK, len(held) - 1)
            best = np.argpartition(d, n - 1, axis=1)[:, :n] if n else np.zeros((len(held), 0), int)
            a = np.repeat(ids, n)
            held.clear()
            return _table(["a", "b", "d"], pa.array(a), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel()))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (held[0][:2] != row[:2] or len(held) >= (BLOCK if row[1] < TREES else RANDOM_BLOCK)):
                    yield pairs()
                held.append(row)
        if held:
            yield pairs()

    keyed = nodes.select("node", "code", "scale", F.length("code").alias("dim"), F.arrow_udf(signs, "array<long>")("code", F.length("code"), "node").alias("signs"))
    spread = keyed.select("dim", "node", "code", "scale", F.posexplode("signs").alias("tree", "sign"))
    ordered = spread.repartitionByRange(max(1, -(-count * (TREES + 1) // TASK_ROWS)), "dim", "tree", "sign", "node").sortWithinPartitions("dim", "tree", "sign", "node")
    return ordered.select("dim", "tree", "node", "code", "scale").mapInArrow(compare, "a long, b long, d float")


def _by_node(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set(F.when(F.col("d").isNotNull(), F.struct(F.col("d").alias("d"), F.col("b").alias("node")))).alias("found"), F.collect_set(F.when(F.col("d").isNull(), F.col("b"))).alias("used"))


def _sampled(state: DataFrame, most: int, by_fresh: bool, seed: int) -> DataFrame:
    """(v, u, fresh): of the links that lead to u, `most` taken at random (of fresh and of old ones each)."""
    links = state.select(F.col("node").alias("v"), F.explode("links").alias("e")).select("v", F.col("e.node").alias("u"), "e.fresh")
    order = W.partitionBy("u", "fresh") if by_fresh else W.partitionBy("u")
    ranked = links.withColumn("rank", F.row_number().over(order.orderBy(F.xxhash64("v", "u", F.lit(seed)), "v")))
    return ranked.where(F.col("rank") <= most).select("v", "u", "fresh")


def _gathered(pairs: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """(at, members): the members' columns of `state`, brought to where they are wanted."""
    told = pairs.join(state, F.col("member") == F.col("node")).select("at", F.struct("member", *columns).alias("m"))
    return told.groupBy("at").agg(F.collect_list("m").alias("members"))


def _compared(gathered: DataFrame) -> DataFrame:
    """(a, b, d) of pairs of members, one of them fresh, which would get into a's list; d is null for
    the fresh links of a that took part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, members = batch.columns
            nodes, flat = at.to_numpy(zero_copy_only=False), members.flatten()
            bounds = np.r_[0, np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]
            member, fresh, own, last, scale = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("member", "fresh", "own", "last", "scale"))
            fresh, own = fresh.astype(bool), own.astype(bool)
            codes = flat.field("code")
            raw, starts = _rows(codes, pc.binary_length(codes).to_numpy(zero_copy_only=False))
            out: list[tuple[np.ndarray, ...]] = []
            for row, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                used = member[lo:hi][own[lo:hi] & fresh[lo:hi]]
                out.append((np.full(len(used), nodes[row]), used, np.full(len(used), np.nan, np.float32)))
                order = np.lexsort((~fresh[lo:hi], member[lo:hi])) + lo  # a link that leads both ways comes twice
                order = order[np.r_[True, np.diff(member[order]) > 0]]
                x = raw[starts[lo] : starts[hi]].reshape(hi - lo, -1)[order - lo]
                ids, new = member[order], fresh[order]
                d = _distances(x, x, scale[order], scale[order])
                np.fill_diagonal(d, np.inf)
                i, j = np.nonzero((d < last[order][:, None]) & (new[:, None] | new[None, :]))
                out.append((ids[i], ids[j], d[i, j]))
            a, b, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
            yield _table(["a", "b", "d"], pa.array(a), pa.array(b), pa.array(d, mask=np.isnan(d)))

    return gathered.mapInArrow(run, "a long, b long, d float")


def _round(state: DataFrame, number: int) -> DataFrame:
    some = _sampled(state, SAMPLE, True, number)
    both = some.select(F.col("v").alias("at"), F.col("u").alias("member"), "fresh", F.lit(True).alias("own")).union(some.select("u", "v", "fresh", F.lit(False)))
    told = state.select("node", "code", "scale", _last(F.col("links"), LINKS).alias("last"))
    pairs = _by_node(_compared(_gathered(both, told, ["fresh", "own", "last", "scale", "code"])))
    joined = state.join(pairs, "node", "left")
    none = F.array().cast("array<long>")
    links = F.transform("links", lambda e: F.struct(e["d"].alias("d"), e["node"].alias("node"), (e["fresh"] & ~F.array_contains(F.coalesce("used", none), e["node"])).alias("fresh")))
    return joined.select("node", "code", "scale", _merged(links, F.coalesce("found", F.array().cast("array<struct<d:float,node:long>>")), LINKS).alias("links"))


@dataclass(frozen=True)
class NeighbourGraph:
    """A built graph: `vectors` (key, v, ids), `opened` (node, members, scales, codes), bucketed by
    node so that no search moves it, and the sizes that vectors were divided by."""

    vectors: DataFrame
    opened: DataFrame
    seeds: list[tuple[int, bytes, float]]
    size: tuple[float, float]


@contextmanager
def _bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    spark, name = df.sparkSession, f"pagemill_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", fresh_path(spark, "graph")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def neighbour_graph(vectors: DataFrame, k: int, seed: int = 11) -> Iterator[NeighbourGraph]:
    """The graph of (id, v) rows, v as usable() gives it. Equal vectors are one node; only
    vectors of one length are linked. Its tables go when the context ends."""
    known = _distinct(vectors, k)
    count, size = known.count(), _size(known)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scales = _small(batch.column(1).to_pylist(), size, False)
            yield _table(["node", "code", "scale"], batch.column(0), pa.array(codes, pa.binary()), pa.array(scales))

    nodes = written(known.select("key", "v").mapInArrow(shrink, "node long, code binary, scale float"), "nodes")
    none = F.array().cast(f"array<{_LINK}>")
    begun = nodes.join(_by_node(_first_pairs(nodes, count, seed)), "node", "left")
    state = written(begun.select("node", "code", "scale", F.when(F.col("found").isNull(), none).otherwise(_merged(none, F.col("found"), LINKS)).alias("links")), "links")
    number = 0
    while state.agg(F.coalesce(F.sum(F.size(F.filter("links", lambda e: e["fresh"]))), F.lit(0))).first()[0] > FEW * LINKS * count:
        with scratch(known.sparkSession) as keep:
            state, number = written(_round(state, number), "links"), number + 1
            keep(state)
    out = state.select(F.col("node").alias("at"), F.explode("links.node").alias("member"))
    back = _sampled(state, LINKS, False, seed).select(F.col("u").alias("at"), F.col("v").alias("member"))
    opened = _gathered(out.union(back).distinct(), nodes, ["scale", "code"])
    packed = F.aggregate("members", F.lit(b""), lambda all_, m: F.concat(all_, m["code"]))
    with _bucketed(opened.select(F.col("at").alias("node"), F.col("members.member").alias("members"), F.col("members.scale").alias("scales"), packed.alias("codes")), "node") as table:
        seeds = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(SEEDS).collect()
        yield NeighbourGraph(known, table, [(r.node, bytes(r.code), r.scale) for r in seeds], size)


# Searching -------------------------------------------------------------------------------------------


def _started(graph: NeighbourGraph, asked: DataFrame) -> DataFrame:
    """(query, q_code, q_scale, pool) of (query, v, own) rows, own being the key of an equal vector or null."""
    size, seeds = graph.size, graph.seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, own = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            codes, scales = _small(values, size, True)
            nodes, node_scales = _small(values, size, False)
            pools = []
            for i, code in enumerate(codes):
                entries = [(own[i], nodes[i], node_scales[i])] if own[i] is not None else [s for s in seeds if len(s[1]) == len(code)]
                q = np.frombuffer(code, np.int8)[None, :]
                found = [(float(_distances(np.frombuffer(c, np.int8)[None, :], q, np.float32([s]), scales[i : i + 1])[0, 0]), n, True) for n, c, s in entries]
                pools.append([dict(zip(("d", "node", "fresh"), e)) for e in sorted(found)[:ENTRIES]])
            kind = pa.list_(pa.struct([("d", pa.float32()), ("node", pa.int64()), ("fresh", pa.bool_())]))
            yield _table(["query", "q_code", "q_scale", "pool"], batch.column(0), pa.array(codes, pa.binary()), pa.array(scales), pa.array(pools, kind))

    return asked.select("query", "v", "own").mapInArrow(run, f"query long, q_code binary, q_scale float, pool array<{_LINK}>")


def _scored(beams: DataFrame) -> DataFrame:
    """(query, d, node) of the members that would get into the query's pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, q_scale, last, members, scales = (batch.column(i) for i in (0, 2, 3, 4, 5))
            query, q_scale, last = (c.to_numpy(zero_copy_only=False) for c in (query, q_scale, last))
            flat, flat_scales = members.flatten().to_numpy(zero_copy_only=False), scales.flatten().to_numpy(zero_copy_only=False)
            bounds = np.r_[0, np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]
            out = []
            for row, (q_code, codes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(6).to_pylist())):
                lo, hi = bounds[row], bounds[row + 1]
                x, q = np.frombuffer(codes, np.int8).reshape(hi - lo, -1), np.frombuffer(q_code, np.int8)[None, :]
                d = _distances(x, q, flat_scales[lo:hi], q_scale[row : row + 1])[:, 0]
                near = np.flatnonzero(d < last[row])
                out.append((np.full(len(near), query[row]), d[near], flat[lo:hi][near]))
            q, d, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64))
            yield _table(["query", "d", "node"], pa.array(q), pa.array(d), pa.array(n))

    return beams.select("query", "q_code", "q_scale", "last", "members", "scales", "codes").mapInArrow(run, "query long, d float, node long")


def search(graph: NeighbourGraph, asked: DataFrame, pool: int = POOL, opened: int = OPENED) -> DataFrame:
    """(query, pool) for (query, v, own) rows: the entries found, best first, each as (d, node, fresh)."""
    spark = asked.sparkSession
    state = written(_started(graph, asked), "pools")
    while state.where(F.exists("pool", lambda e: e["fresh"])).limit(1).count():
        with scratch(spark) as keep:
            taken = F.slice(F.filter("pool", lambda e: e["fresh"]), 1, opened)
            now = state.withColumn("taken", F.transform(taken, lambda e: e["node"]))
            beams = now.select("query", "q_code", "q_scale", _last(F.col("pool"), pool).alias("last"), F.explode("taken").alias("node")).join(graph.opened, "node")
            found = _scored(beams).groupBy("query").agg(F.collect_set(F.struct("d", "node")).alias("found"))
            closed = F.transform("pool", lambda e: F.struct(e["d"].alias("d"), e["node"].alias("node"), (e["fresh"] & ~F.array_contains("taken", e["node"])).alias("fresh")))
            empty = F.array().cast("array<struct<d:float,node:long>>")
            merged = _merged(closed, F.coalesce("found", empty), pool)
            state = written(now.join(found, "query", "left").select("query", "q_code", "q_scale", merged.alias("pool")), "pools")
            keep(state)
    return state.select("query", "pool")


def nearest_neighbours(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", refined: int = 3) -> DataFrame:
    """For each row whose id `is_query` selects, the k nearest other rows that a search of the graph finds.

    Returns query_id, rank (from 1), vec_id and score: the inner product of the original vectors
    in double precision, by which the best `refined` * k of the pool are ranked; ties go to the
    smaller id. A query with fewer than k candidates lists all that are found. Vectors that are
    null or zero or hold null or non-finite components, and rows with a null id, take no part; only
    vectors of equal length meet. Rows that repeat an id can fill several ranks, but no row with the
    query's own id is one of its candidates; a query id that repeats is asked once, with its
    smallest vector. Other columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), usable(F.col(f"`{vector_col}`")).alias("v")).where("id is not null and v is not null")
    with scratch(vectors.sparkSession) as keep, neighbour_graph(rows, k) as graph:
        wanted = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
        asked = written(wanted.join(graph.vectors.select("key", "v"), "v").select(F.col("id").alias("query_id"), F.col("key").alias("query")), "asked")
        questions = graph.vectors.join(asked.select(F.col("query").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("query"), "v", F.col("key").alias("own"))
        pools = search(graph, questions)
        best = pools.select("query", F.explode(F.slice("pool", 1, refined * k)).alias("e")).select("query", F.col("e.node").alias("key"))
        near = best.join(graph.vectors, "key").select("query", F.col("v").alias("w"), "ids").join(questions, "query")
        scored = near.select("query", F.struct((-inner_product(F.col("w"), F.col("v"))).alias("less"), "ids").alias("a"))
        answers = written(scored.groupBy("query").agg(F.collect_list("a").alias("found")), "answers")
        keep(asked, answers)
    each = F.flatten(F.transform("found", lambda a: F.flatten(F.transform(a["ids"], lambda i: F.array_repeat(F.struct(a["less"].alias("less"), i["id"].alias("vec_id")), i["c"])))))
    others = F.slice(F.sort_array(F.filter(each, lambda e: e["vec_id"] != F.col("query_id"))), 1, k)
    ranked = asked.join(answers, "query").select("query_id", F.posexplode(others).alias("place", "e"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.less")).alias("score"))
