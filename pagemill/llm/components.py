"""Connected components of a link table, without ever holding the links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import scratch, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: at most one link a node remains."""
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["a", "b"])


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and their number with a checksum, counted while they are written."""
    seen = Observation()
    out = written(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")), "links", few=True)
    return out, (seen.get["n"], seen.get["s"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node that can be reached.

    Each partition first contracts its own links by union-find; the rest
    converges by alternating large-star and small-star rounds, each an
    aggregation and a join, written to the shared folder. Nodes without links
    to others are absent. Links to itself and repeated links change nothing;
    rows with a null end are ignored.
    """
    kind = links.schema["a"].dataType.simpleString()
    with scratch(links.sparkSession) as keep:
        links, before = _written(links.where("a <> b").toDF("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}"))
        while before[0]:
            both = links.select("a", "b").union(links.select("b", "a"))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
            links, after = _written(small)
            if after == before:
                break
            before = after
        labels = written(links.toDF("node", "root"), "labels", few=True)
        keep(labels)
    return labels
