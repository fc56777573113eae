"""Lifecycle scores. ``now`` is always a literal, so that plans are deterministic and fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    recency: float = 1.0
    importance: float = 1.0
    access: float = 0.5
    staleness_penalty: float = 0.8
    half_life_days: float = 30.0


def age_days(created: Column, now: Column) -> Column:
    """Both ends are time stamps without a zone."""
    return F.timestamp_diff("MICROSECOND", created, now) / 86_400_000_000.0


def recency(created: Column, now: Column, half_life_days: float = 30.0) -> Column:
    return F.pow(F.lit(2.0), -age_days(created, now) / half_life_days)


def access_score(count: Column) -> Column:
    return F.when(count <= 0, F.lit(0.0)).otherwise(F.log1p(count.cast("double")))


def lifecycle_score(created: Column, imp: Column, accesses: Column, stale: Column, now: Column, w: Weights = Weights()) -> Column:
    whole = w.recency * recency(created, now, w.half_life_days) + w.importance * imp + w.access * access_score(accesses)
    return F.when(stale, whole * max(0.0, 1 - w.staleness_penalty)).otherwise(whole)


def becomes_stale(created: Column, imp: Column, accesses: Column, stale: Column, now: Column, max_age_days: float = 90.0, min_access: int = 1, min_importance: float = 1.0) -> Column:
    """Old, hardly read, unimportant and not yet marked."""
    return (age_days(created, now) > max_age_days) & (accesses < min_access) & (imp <= min_importance) & ~stale


def with_lifecycle(memories: DataFrame) -> DataFrame:
    """Fills a missing ``lifecycle`` struct from ``created_at`` and refreshes the content hash."""
    at = lambda f, d: F.coalesce(F.col(f"lifecycle.{f}"), d)
    full = F.struct(at("importance", F.lit(1.0)).alias("importance"), at("access_count", F.lit(0).cast("bigint")).alias("access_count"), F.col("lifecycle.last_accessed_at").alias("last_accessed_at"), at("created_at", F.col("created_at")).alias("created_at"), content_hash(F.col("text")).alias("content_hash"), at("stale", F.lit(False)).alias("stale"))
    return memories.withColumn("lifecycle", full)


def touch(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Counts one more access for the rows whose ``pos`` is in ``ids``."""
    hit = ids.select("pos").distinct().withColumn("_hit", F.lit(True))
    life = F.col("lifecycle")
    new = life.withField("access_count", life["access_count"] + 1).withField("last_accessed_at", now)
    return memories.join(hit, "pos", "left").withColumn("lifecycle", F.when(F.col("_hit"), new).otherwise(life)).drop("_hit")


def accessed(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """``memories`` after the ``(pos, at, seq)`` of an append-only table: counts go up by its rows, and the time is that of the
    largest ``seq``. The same rows as :func:`touch` called for each ``seq`` in turn; positions that are not there have no effect."""
    sums = accesses.groupBy("pos").agg(F.count("*").alias("_more"), F.max_by("at", "seq").alias("_at"))
    life = F.col("lifecycle")
    new = life.withField("access_count", life["access_count"] + F.col("_more")).withField("last_accessed_at", F.col("_at"))
    return memories.join(sums, "pos", "left").withColumn("lifecycle", F.when(F.col("_more").isNotNull(), new).otherwise(life)).select(*memories.columns)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def memory_key(text: Column, created: Column) -> Column:
    return F.sha2(F.concat_ws("::", text, created), 256)


def workspace_hash(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)


def content_dedup(memories: DataFrame) -> DataFrame:
    """For each text the row created last (the first of ties), ordered by where the text was first seen."""
    by_text = Window.partitionBy(content_hash(F.col("text")))
    ranked = memories.withColumns({"_rank": F.row_number().over(by_text.orderBy(F.col("created_at").desc(), "pos")), "first_pos": F.min("pos").over(by_text)})
    return ranked.where("_rank = 1").drop("_rank")
