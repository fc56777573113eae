"""Reading tables so that every core has work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table of one small file is one task; dealing its rows out costs little and lets all cores share expensive
    expressions. A table with as many files, or splits by size, as there are cores is returned as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    splits = max(len(df.inputFiles()), size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if splits < cores else df
