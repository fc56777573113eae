"""First-order transitions as a sparse edge table ``(prev, next, cnt)``."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class PredictionPolicy(Protocol):
    """What a predictor of the next item needs. ``edges`` is its whole state, a table it makes itself."""

    def update(self, edges: DataFrame, events: DataFrame) -> DataFrame: ...

    def predict(self, edges: DataFrame) -> DataFrame: ...

    def surprise(self, edges: DataFrame, pairs: DataFrame) -> DataFrame: ...

    def reset(self, edges: DataFrame) -> DataFrame: ...


def transitions(events: DataFrame, session: str = "session", order: tuple[str, ...] = ("step",), item: str = "item") -> DataFrame:
    """Counts of consecutive items within a session."""
    prev = F.lag(item).over(Window.partitionBy(session).orderBy(*order))
    return events.select(prev.alias("prev"), F.col(item).alias("next")).where("prev is not null").groupBy("prev", "next").agg(F.count("*").alias("cnt"))


def predict_next(edges: DataFrame) -> DataFrame:
    """The commonest successor, the lowest of ties."""
    w = Window.partitionBy("prev").orderBy(F.col("cnt").desc(), "next")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("prev", "next", "cnt")


def surprise(edges: DataFrame, pairs: DataFrame, n_items: int, smoothing: float = 1.0) -> DataFrame:
    """``pairs(prev, next)`` -> ``1 - (count + a) / (total + a * K)``; 1 where ``prev`` was never left or is null."""
    totals = edges.groupBy("prev").agg(F.sum("cnt").alias("total"))
    joined = pairs.select("prev", "next").join(totals, "prev", "left").join(edges, ["prev", "next"], "left")
    p = (F.coalesce("cnt", F.lit(0)) + smoothing) / (F.col("total") + smoothing * n_items)
    return joined.select("prev", "next", F.when(F.col("total").isNull(), F.lit(1.0)).otherwise(1 - p).alias("surprise"))


def self_surprise(edges: DataFrame, items: DataFrame, n_items: int, smoothing: float = 1.0) -> DataFrame:
    """The surprise of an item after itself, as the learn report gives it."""
    return surprise(edges, items.select(F.col("item").alias("prev"), F.col("item").alias("next")), n_items, smoothing).select(F.col("prev").alias("item"), "surprise")


def chained(items: DataFrame, last: str | None) -> DataFrame:
    """``items(step, item)`` as one session that goes on after ``last``, the last item of the call before."""
    rows = items.select(F.lit(0).alias("session"), F.col("step").cast("bigint").alias("step"), F.col("item").cast("string").alias("item"))
    if last is None:
        return rows
    return rows.unionByName(items.sparkSession.createDataFrame([(0, -1, last)], "session int, step bigint, item string"))


class FirstOrder:
    """The default policy: transition counts with additive smoothing over ``n_items``."""

    def __init__(self, n_items: int, smoothing: float = 1.0) -> None:
        self.n_items, self.smoothing = n_items, smoothing

    def update(self, edges: DataFrame, events: DataFrame) -> DataFrame:
        """``edges`` and the transitions of ``events(session, step, item)``, added up."""
        return edges.unionByName(transitions(events)).groupBy("prev", "next").agg(F.sum("cnt").alias("cnt"))

    def predict(self, edges: DataFrame) -> DataFrame:
        return predict_next(edges)

    def surprise(self, edges: DataFrame, pairs: DataFrame) -> DataFrame:
        return surprise(edges, pairs, self.n_items, self.smoothing)

    def reset(self, edges: DataFrame) -> DataFrame:
        return edges.limit(0)
