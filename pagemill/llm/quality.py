"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A document becomes a dozen transformed statistics of its whole text. Each
class has its own mean and a covariance that is shrunk towards the pooled one
and towards a multiple of the identity. The score is the posterior of class 1
from the difference of the two log densities, whose Mahalanobis distances come
from the classes' Cholesky factors, computed once at fitting.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, utf8, written

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "signs", "digits", "distinct_words", "top_word", "distinct_lines", "stops", "log_lines", "longest_word"]
_SIGNS = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", np.uint8))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text; shares enter as logarithms,
    smoothed so that they are finite for the empty text."""

    def share(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole + 1)))

    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    seen = Counter(words)
    n = len(words)
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), len(text) / n if n else 0.0,
        share(counts[65:91].sum(), len(text)), share(counts[_SIGNS].sum(), len(text)), share(counts[48:58].sum(), len(text)),
        share(len(seen), n), share(max(seen.values(), default=0), n), share(len(set(lines)), len(lines)),
        share(counts[44] + counts[46], n), float(np.log1p(len(lines))), share(max(map(len, seen), default=0), 50),
    ]


def _statistics(texts: pa.Array) -> pa.Array:
    x = np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(STATISTICS))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, x): every row, packed, and the statistics of its text; a null text counts as empty."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.arrow_udf(_statistics, "array<double>")(utf8(text_col)).alias("x"))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log weights of classes 0 and 1; `share` is
    the score of every row where a class had no rows to learn from."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    share: float

    def column(self, x: Column) -> Column:
        """The score of a column of statistics."""
        if len(self.classes) < 2:
            return F.lit(float(self.share))
        numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  the value is computed once
        z = F.zip_with(F.zip_with(x, numbers(self.centre), lambda v, c: v - c), numbers(self.scale), lambda v, s: v / s)

        def density(z: Column, mean: np.ndarray, factor: np.ndarray, weight: float) -> Column:
            """Log weight less half the squared Mahalanobis distance, by the inverse Cholesky factor."""
            rows = F.array(*[numbers(r) for r in factor])
            turned = lambda off: F.transform(rows, lambda r: total(F.zip_with(off, r, lambda v, f: v * f)))
            return F.lit(weight) - 0.5 * let(F.zip_with(z, numbers(mean), lambda v, m: v - m), lambda off: total(F.transform(turned(off), lambda t: t * t)))

        def score(z: Column) -> Column:
            zero, one = (density(z, *c) for c in self.classes)
            return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), zero - one))))

        return let(z, score)


def fit(labelled: DataFrame, shrinkage: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Fits (x, label) rows from their counts, sums and sums of products by class,
    which Spark adds up: all labelled rows count, and 2 rows reach the driver.
    Rows whose label is not 0 or 1 are left out."""
    d = len(STATISTICS)
    at = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v) for v in at] + [F.sum(at[i] * at[j]) for i in range(d) for j in range(i, d)]
    rows = labelled.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*"), *sums).collect()
    found = {r[0]: (r[1], np.array(r[2 : 2 + d], float), np.array(r[2 + d :], float)) for r in rows}
    n = {c: found[c][0] if c in found else 0 for c in (0, 1)}
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    if not (n[0] and n[1]):
        return Discriminant(np.zeros(d), np.ones(d), (), share)
    means, covariances = {}, {}
    for c, (count, s, products) in found.items():
        full = np.zeros((d, d))
        full[np.triu_indices(d)] = products
        full = full + full.T - np.diag(np.diag(full))
        means[c] = s / count
        covariances[c] = full / count - np.outer(means[c], means[c])
    weight = {c: n[c] / (n[0] + n[1]) for c in (0, 1)}
    centre = sum(weight[c] * means[c] for c in (0, 1))
    between = sum(weight[c] * np.outer(means[c] - centre, means[c] - centre) for c in (0, 1))
    pooled = sum(weight[c] * covariances[c] for c in (0, 1))
    scale = np.sqrt(np.maximum(np.diag(pooled + between), 1e-12))
    classes = []
    for c in (0, 1):
        own = ((1 - shrinkage) * covariances[c] + shrinkage * pooled) / np.outer(scale, scale)
        own += (ridge * np.trace(own) / d + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(own)
        classes.append(((means[c] - centre) / scale, np.linalg.inv(factor), float(np.log(weight[c]) - np.log(np.diag(factor)).sum())))
    return Discriminant(centre, scale, tuple(classes), share)


def held_out(id_col):
    """Whether a row's label is kept for measuring: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns a label from the labelled documents that are not held out, and scores all.

    Returns one row for each input row: id, held_out, score (0 to 1, higher:
    label 1 likelier) and predicted (1 from `threshold` on, else 0). Only the
    text enters a score. Null and empty texts have finite statistics and are
    scored like others; a row with a null id is scored, learns nothing and is
    not held out. Rows that repeat an id are each scored on their own text and
    each learn its label; repeated label rows count as often as they stand.
    Without labelled rows of both classes every score is the smoothed share of
    class 1: (n1 + 1) / (n + 2). Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    with scratch(docs.sparkSession) as keep:
        features = written(with_statistics(rows).select("row.id", "x"), "statistics")
        model = fit(features.where(~held_out(F.col("id"))).join(known, "id"))
        keep(features)
    out = features.select("id", held_out(F.col("id")).alias("held_out"), model.column(F.col("x")).alias("score"))
    return out.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
