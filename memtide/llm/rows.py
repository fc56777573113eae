"""Rows by identity: an id may be null or stand on rows that differ, so a row is named by its id and a hash of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of rows that may be sent to every task; more are shuffled.
MAX_KEYS = 1_000_000


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def by_size(table: DataFrame, most: int) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``most`` rows, which a count of its files tells."""
    return F.broadcast(table) if table.count() <= most else table


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among ``keys`` ``(doc_id, t)``, a written table. Null ids are equal."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key().alias("t"))
    gone = by_size(keys.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")), MAX_KEYS)
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left_anti").select("row.*")
