"""Substring search over texts by an inverted index of trigrams.

The index is a table of posting lists: for each trigram and each block of 65,536
documents the documents' numbers, as differences in bytes of seven bits. A search reads the lists of
its trigrams only, intersects them block by block, and verifies what is left on
the full texts, of which the pages that hold candidates are read. Texts are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a block: a posting list has no more numbers than that.
BLOCK = 1 << 16
#: Rows of a page of the text table, so that few texts come along with a candidate.
PAGE_ROWS = 64
#: Distinct trigrams, summed over documents, whose lists a task makes at once, besides the document that goes beyond them.
GROUP_GRAMS = 2_000_000
#: So many candidates are sent to the driver to narrow the read to RANGES ranges; beyond that the candidates are joined alone.
FEW, RANGES = 20_000, 64


def grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def gram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as a number: its code points in 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else points[:0]


def _gram_of(code: int) -> str:
    return chr(code >> 42) + chr((code >> 21) & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _partial_lists(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """The posting lists of some documents (number, trigrams) of one block, ascending."""
    held = sorted(held, key=lambda h: h[0])
    codes = np.concatenate([c for _, c in held])
    at = np.repeat(np.array([n % BLOCK for n, _ in held], np.int64), [len(c) for _, c in held])
    order = np.argsort(codes, kind="stable")
    codes, at = codes[order], at[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    data, lengths = _varints(gaps)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.append(first, len(at))].astype(np.int32)
    numbers = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    block = np.full(len(first), held[0][0] // BLOCK)
    return pa.RecordBatch.from_arrays([pa.array([_gram_of(c) for c in codes[first].tolist()], pa.string()), pa.array(block), pa.array(np.diff(np.append(first, len(at))), pa.int32()), numbers], ["gram", "block", "n", "numbers"])


def _varints(gaps: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The differences in bytes of seven bits, and how many bytes each takes."""
    parts = np.stack([(gaps >> 14) | 0x80, ((gaps >> 7) & 0x7F) | 0x80, gaps & 0x7F], 1).astype(np.uint8)
    used = np.stack([gaps >= 1 << 14, gaps >= 1 << 7, np.ones(len(gaps), bool)], 1)
    return parts[used].tobytes(), used.sum(1)


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers below BLOCK as differences; the last byte of each has its high bit clear."""
    return _varints(np.diff(numbers, prepend=0))[0]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    first = np.r_[0, ends[:-1] + 1]
    value = np.zeros(len(ends), np.int64)
    for k in range(3):
        at = first + k
        more = at <= ends
        value[more] = (value[more] << 7) | (raw[at[more]] & 0x7F)
    return np.cumsum(value)


@dataclass(frozen=True)
class TrigramIndex:
    """Tables below a folder: texts (number, id, text) by number, and postings (gram, block, n, numbers) by trigram."""

    spark: SparkSession
    folder: str

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/texts")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")


def build_index(docs: DataFrame, id_col: str, text_col: str, folder: str) -> TrigramIndex:
    """Writes the index of the rows. Null texts are in no list and no result; rows that repeat an id each count."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    numbered.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.page.size.row.check.min", 1).parquet(f"{folder}/texts")
    index = TrigramIndex(spark, folder)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each trigram of some documents of a block their numbers, so that a row is shuffled for many documents."""
        for batch in batches:
            held, size = [], 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and (size >= GROUP_GRAMS or number // BLOCK != held[0][0] // BLOCK):
                    yield _partial_lists(held)
                    held, size = [], 0
                held.append((number, codes := gram_codes(text.as_py())))
                size += len(codes)
            if held:
                yield _partial_lists(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [v if len(v) == 1 else [packed(np.sort(np.concatenate([unpacked(p) for p in v])))] for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v[0] for v in lists], pa.binary())], ["gram", "block", "n", "numbers"])

    rows = index.texts.where(F.col("text").isNotNull()).select("number", F.lower("text").alias("text")).mapInArrow(split, "gram string, block long, n int, numbers binary")
    # A list has a part for each GROUP_GRAMS trigrams or batch of a block's documents.
    lists = rows.groupBy("gram", "block").agg(F.sum("n").cast("int").alias("n"), F.collect_list("numbers").alias("parts"))
    stored = lists.mapInArrow(pack, "gram string, block long, n int, numbers binary")
    stored.sortWithinPartitions("gram", "block").write.parquet(f"{folder}/postings")  # sorted, so that a read of few trigrams skips most of each file
    return index


def _candidates(index: TrigramIndex, wanted: dict[str, set[str]]) -> DataFrame:
    """(query, number) of the documents whose lists hold all trigrams of a query."""
    spark = index.spark
    pairs = spark.createDataFrame([(q, g, len(own)) for q, own in wanted.items() for g in sorted(own)], "query string, gram string, size int")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, block, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left = None
                for data in sorted(lists, key=len):
                    left = unpacked(data) if left is None else np.intersect1d(left, unpacked(data), assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(left), pa.string()), pa.array(left + block * BLOCK)], ["query", "number"])

    every = sorted({g for own in wanted.values() for g in own})
    lists = index.postings.where(F.col("gram").isin(every)).join(F.broadcast(pairs), "gram")  # as many rows as the queries have trigrams
    full = lists.groupBy("query", "block").agg(F.collect_list("numbers").alias("lists"), F.first("size").alias("size")).where(F.size("lists") == F.col("size"))
    return full.select("query", "block", "lists").mapInArrow(intersect, "query string, number long")


def _ranges(numbers: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all the numbers, parted at the widest gaps."""
    values = np.unique(np.array(numbers, np.int64))
    gaps = np.diff(values)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cuts = cuts[gaps[cuts] > 1]
    return list(zip(values[np.r_[0, cuts + 1]].tolist(), values[np.r_[cuts, len(values) - 1]].tolist()))


def _holding(texts: DataFrame, queries: Column) -> DataFrame:
    """(query, id) of the queries that each text holds; a text is put in lower case once."""
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(queries, lambda q: F.contains(t, q)))[0]
    return texts.select(F.explode(held).alias("query"), "id")


def substring_search(index: TrigramIndex, queries: list[str]) -> DataFrame:
    """(query, id) for each row whose text holds a query, whatever the case. Queries are trimmed; those of
    fewer than three characters have no trigram, so that for them all texts are read."""
    spark = index.spark
    wanted = {q: grams(q) for q in dict.fromkeys(q.strip().lower() for q in queries)}
    short = [q for q, own in wanted.items() if not own]
    none = spark.createDataFrame([], "query string").join(index.texts.select("id").limit(0))
    found = [none]
    if long := {q: own for q, own in wanted.items() if own}:
        candidates = _candidates(index, long)
        some = candidates.select("number").distinct().limit(FEW + 1).collect()
        texts = index.texts
        if not some:
            texts = texts.limit(0)
        elif len(some) <= FEW:
            texts = texts.where(reduce(lambda a, b: a | b, [F.col("number").between(lo, hi) for lo, hi in _ranges([r.number for r in some])]))
        per_text = candidates.groupBy("number").agg(F.collect_list("query").alias("queries"))  # no more than there are queries
        found.append(_holding(per_text.join(texts, "number"), F.col("queries")))
    if short:
        found.append(_holding(index.texts.where(F.col("text").isNotNull()), F.array(*[F.lit(q) for q in short])))
    return reduce(DataFrame.unionByName, found)
