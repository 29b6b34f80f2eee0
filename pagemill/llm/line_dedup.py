"""Line deduplication over a whole corpus.

The 128-bit hashes of the line keys are range-partitioned and sorted by (hash,
document, position), so that each partition streams past the first occurrence
of every hash and can tell the later ones at once. A hash that fills several
partitions is settled by the one row that each partition leaves about its last
hash. What comes back is not text but one compressed keep bitmap a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, utf8, written

#: White space that is stripped from both ends of a line: U+0020 and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20
LATER, HEAD, TAIL = 0, 1, 2
#: Up to so many rows about partitions' last hashes (some MB) are broadcast.
BROADCAST_TAILS = 100_000


def line_key(line: bytes) -> bytes:
    """A line's key: blanks stripped at both ends, A-Z lower-cased."""
    return line.lower().strip(BLANKS)


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else sum(b & 0xC0 != 0x80 for b in key)


def _hash_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            at: list[int] = []
            digests: list[bytes] = []
            for i, text in enumerate(batch.column(2)):
                for k, line in enumerate(text.as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        rows.append(i)
                        at.append(k)
                        digests.append(blake2b(key, digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(take), pa.array(at, pa.int64()), batch.column(1).take(take)],
                ["h1", "h2", "id", "at", "version"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("version"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, f"h1 long, h2 long, id {kind}, at long, version long")


def _later_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a sorted partition. LATER rows are occurrences in a document after
    the first. HEAD rows are those of the partition's first hash in its first
    document here: an earlier partition may hold an earlier one. The one TAIL
    row says in which document the partition's last hash was first seen."""
    head = last = first = last_row = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fresh = np.empty(len(h1), bool)
        fresh[0] = last != (h1[0], h2[0])
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        seen = ids[starts[np.maximum(run, 0)]] if len(starts) else ids.copy()
        if not fresh[0]:
            seen[run < 0] = first
        if head is None:
            head = (h1[0], h2[0])
        kind = np.where(ids != seen, LATER, np.where((h1 == head[0]) & (h2 == head[1]), HEAD, -1)).astype("i4")
        last, first, last_row = (h1[-1], h2[-1]), seen[-1], batch.slice(len(h1) - 1)
        keep = kind >= 0
        if keep.any():
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), *part.columns], ["kind", *part.schema.names])
    if last_row is not None:
        columns = [*last_row.columns]
        columns[2] = pa.array([first], columns[2].type)
        yield pa.RecordBatch.from_arrays([pa.array([TAIL], pa.int32()), *columns], ["kind", *last_row.schema.names])


def _bitmaps(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n: int, gone) -> bytes:
        keep = np.ones(n, bool)
        if gone is not None:
            keep[gone] = False
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes())

    return pd.Series([one(n, gone) for n, gone in zip(n_lines, dropped)])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One compressed keep bitmap for each distinct document version.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A
    key of at least `min_chars` code points that stands in two documents or
    more loses all its lines, except in the smallest id that holds it, which
    keeps all of them, repeats within it included.

    Returns id, version (xxhash64 of the text, to tell apart rows that repeat an
    id), n_lines, n_dropped and keep: zlib-compressed bits, the lowest bit of
    the first byte for the first line, 1 for a line that stays. Rows with
    equal ids are one document: they never drop each other's lines. A null or
    empty text is one empty line. Rows with a null id take no part: they keep
    all lines and have no bitmap. Other columns are not read.
    """
    keys = ["h1", "h2", "id", "at"]
    kind = docs.schema[id_col].dataType.simpleString()
    with scratch(docs.sparkSession) as keep:
        hashed = written(_hash_lines(docs, id_col, text_col, min_chars), "line-hashes")
        told = hashed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_later_occurrences, f"kind int, h1 long, h2 long, id {kind}, at long, version long")
        told = written(told, "line-later", few=True)
        keep(told)
    # As many TAIL rows as there were partitions, whatever the number of lines: small enough to broadcast, which is checked.
    tails = told.where(F.col("kind") == TAIL).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    tails = F.broadcast(tails) if told.where(F.col("kind") == TAIL).count() <= BROADCAST_TAILS else tails
    heads = told.where(F.col("kind") == HEAD).join(tails, ["h1", "h2"]).where(F.col("first") < F.col("id"))
    later = told.where(F.col("kind") == LATER).select("id", "version", "at").unionByName(heads.select("id", "version", "at"))
    dropped = later.groupBy("id", "version").agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("version"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    every = sizes.dropDuplicates(["id", "version"]).join(dropped, ["id", "version"], "left")
    return every.select("id", "version", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.pandas_udf(_bitmaps, "binary")("n_lines", "dropped").alias("keep"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: text (bytes), keep; the text comes back without its dropped lines."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        start, size, out = 0, 0, []
        for i, (text, keep) in enumerate(zip(batch.column(at), batch.column(batch.schema.get_field_index("keep")))):
            data = text.as_py()
            if keep.is_valid:
                lines = data.split(b"\n")
                stays = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=len(lines), bitorder="little")
                data = b"\n".join([line for line, stay in zip(lines, stays) if stay])
            out.append(data)
            size += len(data)
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                columns = [batch.column(k).slice(start, i + 1 - start) for k in range(batch.num_columns)]
                columns[at] = pa.array(out, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
                start, size, out = i + 1, 0, []


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents without the lines that `keep_bitmaps` drops.

    Returns the input rows with all their columns packed in `row` (whatever
    their names), text (the lines that stay, joined by line ends), n_lines and
    n_dropped, both counted on the row's own text. A document all of whose lines
    go has an empty text. Rows with a null id keep all lines.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars).where(F.col("n_dropped") > 0).select("id", "version", "n_dropped", "keep")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("version"), rest, utf8(text_col).alias("text"))
    joined = rows.join(bitmaps, ["id", "version"], "left").select("row", "text", "n_dropped", "keep")
    line_ends = F.length(F.col("text").cast("string")) - F.length(F.replace(F.col("text").cast("string"), F.lit("\n")))
    sized = joined.withColumn("n_lines", (line_ends + 1).cast("long")).withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))
    return sized.mapInArrow(_rebuild, sized.schema).select("row", F.col("text").cast("string").alias("text"), "n_lines", "n_dropped")
