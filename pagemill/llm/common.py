"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables in few files have at least so many for each core of the cluster, and one for so many shuffle partitions.
FILES_A_CORE, PARTITIONS_A_FILE = 4, 8
#: The tables that the innermost open `scratch` has written so far: (path, frame).
_made: ContextVar[list[tuple[str, DataFrame | None]] | None] = ContextVar("_made", default=None)
#: Paths that results still read; they go when the driver ends.
_results: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only a local session that names none (single-machine tests) gets a temporary
    folder, which is set, so that later calls find the same one. On a cluster
    that would be the driver's own disk: RuntimeError.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    path = f"{shared_dir(spark)}/pagemill-{label}-{uuid.uuid4().hex}"
    _remember(spark, path, None)
    return path


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here, and a
    lost executor costs no recomputation of what came before. With `few`, shuffle
    partitions share files, so that a file holds a fixed share of any input: for narrow
    tables. Not where a skewed join comes last, since that would bring its parts together."""
    spark = df.sparkSession
    if few:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(FILES_A_CORE * spark.sparkContext.defaultParallelism, partitions // PARTITIONS_A_FILE))
    path = f"{shared_dir(spark)}/pagemill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _remember(spark, path, back)
    return back


def _remember(spark: SparkSession, path: str, frame: DataFrame | None) -> None:
    made = _made.get()
    if made is None:
        _results.append((spark, path))
    else:
        made.append((path, frame))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Removes the tables written inside it when it ends, but for those handed to the
    function it gives: what a lazy result still reads. These belong to the
    scope around it, or else stay until the driver ends."""
    made: list[tuple[str, DataFrame | None]] = []
    kept: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield lambda *frames: kept.extend(frames)
    except BaseException:
        kept.clear()
        raise
    finally:
        _made.reset(token)
        for path, frame in made:
            if any(frame is k for k in kept):
                _remember(spark, path, frame)
            else:
                _remove(spark, path)


@atexit.register
def _clear_results() -> None:
    for spark, path in _results:
        with suppress(Exception):  # the session may have ended before
            _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_uri(uri: str) -> str:
    """A folder under the name that Arrow knows its store by, where Hadoop's is another."""
    scheme, mark, rest = uri.partition("://")
    if scheme in ("wasb", "wasbs"):
        return f"{scheme.replace('wasb', 'abfs')}{mark}{rest.replace('.blob.', '.dfs.', 1)}"
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest


def utf8(col: str | Column) -> Column:
    """The column's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


_ABSENT = object()


class Bounded(dict):
    """A cache of make(key) by key. When what was asked for lately takes about half of `most`
    bytes (`each` bytes a pair for the dict itself), it becomes the older half, whose
    entries go unless they are asked for again. Results never depend on it."""

    def __init__(self, make: Callable, most: int, each: int = 200):
        self.make, self.most, self.each, self.held, self.older = make, most, each, 0, {}

    def __missing__(self, key):
        value = self.older.get(key, _ABSENT)
        if value is _ABSENT:
            value = self.make(key)
        size = self.each + (len(key[0]) + len(key[1]) if type(key) is tuple else len(key)) + (len(value) if type(value) is bytes else 0)
        if 2 * size > self.most:
            return value
        if 2 * (self.held + size) > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = value
        return value
