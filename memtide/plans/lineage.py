"""Tables that cut lineage, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder. A local one is made only for a local session that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="memtide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/memtide/cut-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._memtide_cut = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def uncut(df: DataFrame) -> None:
    """Delete a table that :func:`cut` made and that nothing will read again."""
    path = getattr(df, "_memtide_cut", None)
    if path:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables that :func:`cut` makes inside are deleted at the end, also after a failure; one taken off the list stays."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for table in made:
            uncut(table)


def settled(work: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``work()``, written; the tables that were made on the way are deleted."""
    outer = _made.get()
    with scope() as made:
        out = cut(work())
        made.remove(out)
    if outer is not None:
        outer.append(out)
    return out


def drain(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Runs a stream over all there is; what it emitted is in the shared folder, a batch that is tried again once."""
    spark, root = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/memtide/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/out/batch=-1")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out/*").select(*stream.columns)
