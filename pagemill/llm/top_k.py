"""Exact top-k search by inner product, in the three phases of the uniform threshold algorithm.

The components are cut into m slices. A slice of a block of vectors is a node,
with its own list of partial scores for each query. (1) The nodes of some blocks
name their best entries for each query; the exact totals of these are gathered,
and the k-th best is a lower bound of the k-th best of all: the cutoff. (2) The
cutoffs are sent to all blocks. A vector whose total reaches the cutoff has a
partial score of at least cutoff / m on some node, so each node gives only its
entries that reach that, and they are sufficient. (3) Of these alone the totals
are resolved exactly, and the best k of those that reach the cutoff are the result.

Every partial score of a pair is computed once in phase 2; phase 1 adds those of
one block in PILOT, and of the first of each length. Equal vectors are one vector with its smallest ids, so that
ties among any number of copies neither travel nor are scored twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written

#: Query blocks whose best entries a task holds before it hands them on.
HELD_BLOCKS = 256
#: Phase 1 asks the nodes of one block in so many, and of the first block of each length. Any k totals give a safe cutoff, so the result doesn't depend on it.
PILOT = 8
#: Entries that a node names for each query in phase 1, times k.
NAMED = 4
#: Tasks that the rows of one block of queries are dealt to before they meet the blocks of vectors.
SALTS = 32


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as doubles (whole numbers); null where the
    vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * scale).cast("double")))


def _packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """(key, v) rows to blocks of up to `size` vectors of one length: keys, and the matrix
    as bytes of the smallest kind of number that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            held = waiting.pop(dim)
            keys = pa.array([[i for i, _ in held]], pa.list_(pa.int64()))
            matrix = np.concatenate([v for _, v in held])
            top = np.abs(matrix).max(initial=0)
            code = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
            return pa.RecordBatch.from_arrays([pa.array([dim]), keys, pa.array([code]), pa.array([matrix.astype(code).tobytes()], pa.binary())], [f"{prefix}{c}" for c in ("dim", "keys", "code", "matrix")])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = v.values.to_numpy(zero_copy_only=False)
                waiting.setdefault(len(values), []).append((i, values))
                if len(waiting[len(values)]) >= size:
                    yield block(len(values))
        for dim in list(waiting):
            yield block(dim)

    schema = ", ".join(f"{prefix}{c}" for c in ("dim long", "keys array<long>", "code string", "matrix binary"))
    return rows.mapInArrow(run, schema).withColumn(f"{prefix}at", F.monotonically_increasing_id())


def _product(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """a @ b.T, exact: doubles hold whole numbers below 2^53, longs below 2^63. Beyond
    that a part saturates so that the sum of `parts` of them still is a long."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    if reach * parts < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, -(2**62) // parts, 2**62 // parts).astype(np.int64)


def local_lists(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """The partial scores of each node: one (query, vector) matrix for each slice."""
    edges = np.linspace(0, q.shape[1], min(slices, max(1, q.shape[1])) + 1).astype(int)
    return [_product(q[:, lo:hi], c[:, lo:hi], len(edges) - 1) for lo, hi in zip(edges, edges[1:])]


def named(parts: list[np.ndarray], r: int, n: int) -> np.ndarray:
    """Phase 1: the places that some node names among its best n for query r."""
    return np.unique(np.concatenate([np.argpartition(-part[r], min(n, part.shape[1]) - 1)[:n] for part in parts]))


def sufficient(parts: list[np.ndarray], r: int, cutoff: int | None) -> np.ndarray:
    """Phase 2: the places whose partial score for query r reaches cutoff / m on some
    node. Without a cutoff (fewer than k candidates seen) all are."""
    if cutoff is None:
        return np.arange(parts[0].shape[1])
    least = -(-cutoff // len(parts))  # whole numbers: at least cutoff / m, rounded up
    enough = parts[0][r] >= least
    for part in parts[1:]:
        enough |= part[r] >= least
    return np.flatnonzero(enough)


def resolved(parts: list[np.ndarray], r: int, places: np.ndarray) -> np.ndarray:
    """Phase 3: the exact totals of these places, and of no other."""
    return sum(part[r, places] for part in parts)


class _Best:
    """The best n (score, key) of each query of a block, over the blocks it has met."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def add(self, query: int, scores: np.ndarray, keys: np.ndarray) -> None:
        if len(scores) > self.n:  # all that tie with the n-th, keys decide below
            keep = scores >= -np.partition(-scores, self.n - 1)[self.n - 1]
            scores, keys = scores[keep], keys[keep]
        old = self.held.get(query, [])
        self.held[query] = sorted(old + list(zip((-scores).tolist(), keys.tolist())))[: self.n]


def _scored(pairs: DataFrame, n: int, slices: int, second: bool) -> DataFrame:
    """(query, score, key): phase 1 (second false), or phases 2 and 3 with `cutoffs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks = _Best(n), set()

        def flush() -> pa.RecordBatch:
            rows = [(q, -s, i) for q, found in best.held.items() for s, i in found]
            best.held = {}
            blocks.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*rows)) or [(), (), ()])], ["query", "score", "key"])

        for batch in batches:
            for row in range(batch.num_rows):
                q_keys, q_code, q_bytes, keys, code, data, dim, *cutoffs = (column[row].as_py() for column in batch.columns)
                q, c = (np.frombuffer(raw, kind).reshape(len(k), dim).astype(np.float64) for raw, kind, k in ((q_bytes, q_code, q_keys), (data, code, keys)))
                parts, keys = local_lists(q, c, slices), np.array(keys)
                for r, query in enumerate(q_keys):
                    cutoff = cutoffs[0][r] if second else None
                    places = sufficient(parts, r, cutoff) if second else named(parts, r, NAMED * n)
                    totals = resolved(parts, r, places)
                    if cutoff is not None:
                        places, totals = places[totals >= cutoff], totals[totals >= cutoff]
                    if len(places):
                        best.add(query, totals, keys[places])
                blocks.add(q_keys[0])
                if len(blocks) >= HELD_BLOCKS:
                    yield flush()
        if best.held:
            yield flush()

    columns = ["q_keys", "q_code", "q_matrix", "keys", "code", "matrix", "dim"] + ["cutoffs"] * second
    return pairs.select(*columns).mapInArrow(run, "query long, score long, key long")


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _met(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries beside each block of vectors of its length. Only block numbers
    are joined by length; the matrices follow by number."""
    numbers = queries.select("q_dim", "q_at").join(blocks.select("dim", "at"), F.col("q_dim") == F.col("dim")).select("q_at", "at", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("salt"))
    spread = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return numbers.join(spread, ["q_at", "salt"]).join(blocks, "at")


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids) from (id, v): one row a distinct vector with its k + 1 smallest ids,
    each with the number of its rows (k at most). Keys follow the order of the smallest ids."""
    counted = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("c"))
    first = counted.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    ids = first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "c"))).alias("ids"))
    placed = ids.withColumn("low", F.col("ids")[0]["id"]).repartitionByRange("low").sortWithinPartitions("low", "v")
    return written(placed.select(F.monotonically_increasing_id().alias("key"), "v", "ids"), "vectors")


def exact_top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = 2, block: int = 2048, query_block: int = 512) -> DataFrame:
    """For each row whose id `is_query` selects, the k other rows with the highest
    inner product of quantised vectors.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller
    id; a query with fewer than k candidates lists all. Vectors that are null or
    hold null or non-finite components, and rows with a null id, take no part.
    Only vectors of equal length meet. Every row is a candidate, so rows that
    repeat an id can fill several ranks, and no row with the query's own id is
    one of its candidates; a query id that repeats is asked once, with its
    smallest vector. Scores beyond 2^62 saturate. Other columns are not read.
    """
    n = k + 1  # one of the best may hold nothing but the query's own id
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    with scratch(vectors.sparkSession) as keep:
        known = _distinct(rows, k)
        wanted = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
        # Equal queries are asked once; the key of a query is that of its vector.
        asked = written(wanted.join(known.select("key", "v"), "v").select(F.col("id").alias("query_id"), F.col("key").alias("query")), "asked")
        n_known, n_asked = known.count(), asked.count()
        questions = known.join(asked.select(F.col("query").alias("key")).distinct(), "key", "left_semi")
        blocks = written(_packed(known.select("key", "v").repartition(max(1, -(-n_known // block))), block, ""), "blocks")
        queries = written(_packed(questions.select("key", "v").repartition(max(1, -(-n_asked // query_block))), query_block, "q_"), "queries")

        some = blocks.where(F.pmod(F.xxhash64("at"), F.lit(PILOT)) == 0).select("at").union(blocks.groupBy("dim").agg(F.min("at").alias("at")).select("at"))
        pilot = blocks.join(some.distinct(), "at", "left_semi")
        found = _ranked(_scored(_met(queries, pilot), n, slices, False), n)
        cutoffs = found.groupBy("query").agg(F.min("score").alias("cutoff"), F.count("*").alias("c")).select("query", F.when(F.col("c") == n, F.col("cutoff")).alias("cutoff"))
        by_block = queries.select("q_at", F.posexplode("q_keys").alias("pos", "query")).join(cutoffs, "query", "left")
        by_block = by_block.groupBy("q_at").agg(F.sort_array(F.collect_list(F.struct("pos", "cutoff"))).getField("cutoff").alias("cutoffs"))
        cut = written(queries.join(by_block, "q_at"), "cutoffs")

        best = _ranked(_scored(_met(cut, blocks), n, slices, True), n).select("query", "score", "key")
        with_ids = best.join(known.select("key", "ids"), "key")
        answers = written(with_ids.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found")), "answers")
        keep(asked, answers)
    each = F.flatten(F.transform("found", lambda a: F.flatten(F.transform(a["ids"], lambda i: F.array_repeat(F.struct((-a["score"]).alias("less"), i["id"].alias("vec_id")), i["c"])))))
    others = F.slice(F.sort_array(F.filter(each, lambda e: e["vec_id"] != F.col("query_id"))), 1, k)
    ranked = asked.join(answers, "query").select("query_id", F.posexplode(others).alias("place", "e"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.less")).alias("score"))
