"""Tables that cut lineage, in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from memtide.plans.lineage import shared_folder, tidy

FILE_BYTES = 256 << 20
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/memtide"


def materialize(df: DataFrame, tag: str, compression: str | None = None, few: bool = False) -> DataFrame:
    """Write ``df`` once to shared storage and return a reader over it.

    A lost executor then costs a re-read of files rather than a re-run of everything upstream. Tables of hashes are
    written with ``compression="none"``: codecs gain nothing on them and hold native buffers for each column. ``few``:
    in few files; not for rows from Python workers, whose Arrow buffers a task keeps until its last partition is done.
    """
    spark, df = df.sparkSession, sized(df) if few else df
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    with tidy(spark):
        (writer.option("compression", compression) if compression else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memtide_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def sized(df: DataFrame) -> DataFrame:
    """``df`` in two partitions for each core, or one for each ``FILE_BYTES`` that Catalyst expects if that is more: few
    bytes make few files."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(scan_bytes(df) // FILE_BYTES, 1_000_000)))


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing will read again."""
    path = getattr(df, "_memtide_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope() -> Iterator[None]:
    """Every table made inside is deleted at the end, whether or not the work succeeded."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for table in made:
            release(table)


def settled(df: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The result of ``df()``, written; the tables that were made on the way are deleted."""
    outer = _made.get()
    with scope():
        out = materialize(df(), tag)
        _made.get().remove(out)
    if outer is not None:
        outer.append(out)
    return out


def settles(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query that leaves its result behind and none of its tables."""

    @wraps(query)
    def run(*args: object) -> DataFrame:
        return settled(lambda: query(*args), query.__name__)

    return run


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``: file sizes for a scan, without a job. It sizes partitions only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
