"""The store decision, and validation of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memtide.functions import text as T
from memtide.functions.rules import RulePack


@dataclass(frozen=True)
class FilterConfig:
    enabled: bool = True
    min_hook_length: int = 5
    min_store_length: int = 1
    min_density: float = 0.3
    max_repetition: float = 0.5
    max_punctuation: float = 0.7
    small_talk_threshold: float = 0.85
    min_hook_importance: float = 0.35


def decide(df: DataFrame, column: str = "text", source: str = "mcp", force: bool = False, config: FilterConfig = FilterConfig(), packs: Sequence[RulePack] | None = None) -> DataFrame:
    """``df`` with ``store``, ``score`` and ``reason``. Explicit stores (``mcp``) only pass the length and gibberish tests.

    The parts are columns of their own, so that each is in the plan once.
    """
    if force or not config.enabled:
        return df.select("*", F.lit(True).alias("store"), F.lit(1.0 if force else 0.5).alias("score"), F.lit("forced" if force else "filtering_disabled").alias("reason"))
    bare, least = F.col("_bare"), config.min_hook_length if source == "hook" else config.min_store_length
    out = df.withColumn("_bare", T.strip(F.coalesce(F.col(column), F.lit(""))))
    out = out.withColumn("_why", T.gibberish_reason(bare, config.min_density, config.max_repetition, config.max_punctuation))
    reason = F.when(bare == "", "empty").when(F.length(bare) < least, "too_short").when(F.col("_why").isNotNull(), F.col("_why"))
    score = F.lit(0.5)
    if source == "hook":
        out = out.withColumns({"_groups": T.script_groups(T.detect_scripts(bare)), "_every": T.sentences(bare)})
        out = out.withColumn("_told", T.telling_sentences(F.col("_every"), F.col("_groups"), packs))
        out = out.withColumn("_text", F.array_join("_told", " "))
        out = out.withColumn("_imp", F.when(F.size("_told") > 0, T.importance(F.col("_text"), F.col("_groups"), packs)).otherwise(F.lit(0.0)))
        ratio = T.small_talk_ratio(F.col("_every"), F.col("_told"), F.col("_groups"), packs)
        reason = reason.when(ratio > config.small_talk_threshold, "mostly_small_talk").when(F.col("_imp") < config.min_hook_importance, "low_importance")
        score = F.col("_imp")
    out = out.withColumn("reason", reason.otherwise("passed"))
    told = F.col("reason").isin("passed", "low_importance")
    return out.select(*df.columns, (F.col("reason") == "passed").alias("store"), F.when(told, score).otherwise(F.lit(0.0)).alias("score"), "reason")


def valid_text(text: Column, max_chars: int = 10_000) -> Column:
    return F.length(text) <= max_chars


def valid_importance(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
