"""Numbers over rows in order, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memtide.plans.lineage import cut


def numbered(df: DataFrame, name: str, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: a row's place, from 0, in ``order``.

    Rows are dealt by ranges; a place is the one in its range plus the counts of the ranges before, a row a range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))
