"""Product quantisation of vectors: codebooks by k-means, entries found with ball trees.

Vectors are whole numbers, cut into parts; each part position has a codebook
of up to 256 entries. A part's nearest entry is found by branch and bound in a
ball tree over the codebook: radii are rounded up and distances to centres
down, a ball is left out only if nothing in it can be as near as the best so
far, and distances are compared as whole numbers, so that the result is that of
a full scan, ties included. The tasks add up the parts of each entry; only these
sums, whose number is that of the codebooks' components, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, written

#: Entries of a codebook: an index is one byte.
ENTRIES = 256
#: Entries of a leaf of the tree.
LEAF = 8
#: Vectors that are searched at once.
BATCH = 4096
#: Components beyond this saturate.
REACH = 2**62
#: Tasks that the rows of one label are dealt to when they meet their sum.
SALTS = 16
_LONGEST = 2**63 - 1


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as longs; null where the vector is null or holds
    a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = lambda v: F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), v))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(bound(v * scale)).cast("long")))


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded down."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) for s in squares], object)
    return np.floor(np.sqrt(squares))


def exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where all that is computed from them stays below 2^53, as Python's integers elsewhere."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(np.float64) if (4 * top + 4) ** 2 * max(1, values.shape[-1]) < 2**53 else values.astype(object)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, exact."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


@dataclass
class Ball:
    """Entries (by index, ascending), a whole centre and a radius that is rounded up; two halves or none."""

    centre: np.ndarray
    radius: int
    index: np.ndarray
    halves: list[Ball]


def ball_tree(book: np.ndarray, index: np.ndarray | None = None) -> Ball:
    """`book`: one row of Python integers for each entry."""
    index = np.arange(len(book)) if index is None else index
    own = book[index]
    centre = np.array([int(s) // len(own) for s in own.sum(0)], object)
    apart = max(int(((e - centre) ** 2).sum()) for e in own)
    ball = Ball(centre, math.isqrt(apart) + 1, index, [])
    if len(index) > LEAF and apart:
        spread = int(np.argmax([int(c) for c in own.max(0) - own.min(0)]))
        order = np.argsort([int(v) for v in own[:, spread]], kind="stable")
        ball.halves = [ball_tree(book, np.sort(index[part])) for part in np.array_split(order, 2)]
    return ball


class Nearest:
    """Finds the nearest entries of a codebook; ties go to the lower index."""

    def __init__(self, book: list[list[int]], tree: Ball):
        self.book, self.tree = np.array(book, object).reshape(len(book), -1), tree
        self.top = max((abs(v) for e in book for v in e), default=0)
        self.floats = self.book.astype(np.float64)
        self.visited = 0  # pairs of a part and a leaf that were compared

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and indices for the rows of x (from exact)."""
        if x.dtype != object and (2 * max(self.top, float(np.abs(x).max(initial=0))) + 4) ** 2 * max(1, x.shape[1]) >= 2**53:
            x = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
        book = self.book if x.dtype == object else self.floats
        best = np.full(len(x), -1, x.dtype)
        at = np.full(len(x), len(book))
        seen = np.full(len(x), -1)  # the leaf that gave the first bound
        leaves: list[Ball] = []

        def compare(leaf: Ball, rows: np.ndarray) -> None:
            self.visited += len(rows)
            found = _squares(x[rows], book[leaf.index])
            low = found.argmin(1)  # the first of equal ones, and indices ascend
            value, index = found[np.arange(len(rows)), low], leaf.index[low]
            better = (best[rows] < 0) | (value < best[rows]) | ((value == best[rows]) & (index < at[rows]))
            best[rows[better]], at[rows[better]] = value[better], index[better]

        def to_centre(ball: Ball, rows: np.ndarray) -> np.ndarray:
            return _squares(x[rows], ball.centre.astype(x.dtype)[None, :])[:, 0]

        def descend(ball: Ball, rows: np.ndarray) -> None:
            """A first bound: the leaf down the nearer halves."""
            if not ball.halves:
                seen[rows] = len(leaves)
                compare(ball, rows)
                leaves.append(ball)
                return
            nearer = to_centre(ball.halves[0], rows) <= to_centre(ball.halves[1], rows)
            for half, mine in zip(ball.halves, (rows[nearer], rows[~nearer])):
                if len(mine):
                    descend(half, mine)

        def bound(ball: Ball, rows: np.ndarray) -> None:
            """Visits what could hold an entry as near as the best: equal ones with a lower index count too."""
            least = _root(to_centre(ball, rows)) - 1 - ball.radius
            rows = rows[(least <= 0) | (least * least <= best[rows])]
            if not len(rows):
                return
            if ball.halves:
                for half in ball.halves:
                    bound(half, rows)
                return
            known = next((i for i, leaf in enumerate(leaves) if leaf is ball), -2)
            if len(rows := rows[seen[rows] != known]):
                compare(ball, rows)

        everyone = np.arange(len(x))
        if len(x):
            descend(self.tree, everyone)
            bound(self.tree, everyone)
        return best, at


Books = list[list[list[int]]]


def _finders(books: Books) -> list[Nearest]:
    return [Nearest(book, ball_tree(np.array(book, object).reshape(len(book), -1))) for book in books]


def cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts; a length that they don't divide is filled up with zeros, which no distance sees."""
    size = -(-vectors.shape[1] // parts)
    filled = np.pad(vectors, ((0, 0), (0, size * parts - vectors.shape[1])))
    return [filled[:, p * size : (p + 1) * size] for p in range(parts)]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _totals(kept: DataFrame, books: Books, length: int) -> list[tuple[int, int, int, int, int]]:
    """(part, entry, place, sum, count) over all vectors, by their nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = _finders(books)
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                for p, x in enumerate(cut(_matrix(batch.column(0).slice(lo, BATCH), length), len(books))):
                    x = exact(x)
                    _, at = finders[p](x)
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(at) else []
                    for own in np.split(order, first[1:]):
                        if len(own):
                            sums = [int(s) for s in x[own].sum(0)]
                            old = held.setdefault((p, int(at[own[0]])), [[0] * len(sums), 0])
                            old[0], old[1] = [a + b for a, b in zip(old[0], sums)], old[1] + len(own)
        for (p, e), (sums, count) in held.items():
            m = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([p] * m, pa.int32()), pa.array([e] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array([count] * m, pa.int64())], ["part", "entry", "place", "total", "n"])

    told = kept.where(F.size("v") == length).select("v").mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n long")
    rows = told.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    return [(r.part, r.entry, r.place, int(r.total), r.n) for r in rows]


def fit(kept: DataFrame, parts: int = 4, rounds: int = 4) -> tuple[Books, int]:
    """Codebooks of (id, v) rows, and the length of the vectors they are for: that of
    the smallest id. They begin as the parts of the vectors of that length with the smallest ids."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return [], 0
    length = len(first[0].v)
    start = kept.where(F.size("v") == length).orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = [part.tolist() for part in cut(np.array([r.v for r in start], object).reshape(len(start), length), parts)]
    for _ in range(rounds if length else 0):
        for p, e, place, total, n in _totals(kept, books, length):
            books[p][e][place] = total // n
    return books, length


def books_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def encode(kept: DataFrame, books: Books, length: int) -> DataFrame:
    """(id, label, code, error): two hexadecimal digits a part, and the sum of the squared
    distances; both null for vectors of another length. Errors beyond a long saturate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = _finders(books)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                fits = np.array([n == length for n in some.column(2).value_lengths().to_pylist()], bool)
                codes, errors = np.full(some.num_rows, None, object), np.full(some.num_rows, None, object)
                if fits.any():
                    own = [finders[p](exact(x)) for p, x in enumerate(cut(_matrix(some.column(2).filter(pa.array(fits)), length), len(books)))]
                    codes[fits] = ["".join(f"{i:02x}" for i in at) for at in zip(*[at for _, at in own])]
                    errors[fits] = [min(_LONGEST, sum(int(d) for d in each)) for each in zip(*[best for best, _ in own])]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    schema = T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.select("id", "label", "v").mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) for every row with a usable vector.

    Rows whose vector is null or holds null or non-finite components go. Components
    beyond 2^62 after scaling saturate, sums beyond a long too. The codebooks are
    for one length of vectors, that of the smallest id; rows with another length stay, with
    null code and error. Rows that repeat an id each count; null ids come last. Lengths that the
    parts don't divide are filled up with zeros. Empty vectors have empty parts: index 0, error 0.
    """
    label = F.col(f"`{label_col}`").alias("label")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label, whole(F.col(f"`{vector_col}`"), scale).alias("v")).where("v is not null")
    with scratch(vectors.sparkSession) as keep:
        kept = written(rows, "whole-vectors")
        books, length = fit(kept, parts, rounds)
        coded = written(encode(kept, books, length), "codes")
        keep(coded)
    # One row a label meets the rows of its label, which may be a third of all, in SALTS tasks.
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    sums = sums.select(F.col("label").alias("of"), F.least("s", F.lit(_LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to")), "left")
    return joined.select("id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
