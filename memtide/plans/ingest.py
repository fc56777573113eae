"""Ingest plans: the two orders in which text is filtered, shortened and redacted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.functions.hooks import summarize
from memtide.functions.redact import redact
from memtide.operators import gate
from memtide.operators.filtering import FilterConfig, decide


def prepare_explicit(items: DataFrame, config: FilterConfig = FilterConfig(), patterns: Sequence[str] | None = None) -> DataFrame:
    """An explicit store: filter, then redact."""
    kept = decide(items, source="mcp", config=config).where("store").drop("store", "score", "reason")
    return kept.withColumn("text", redact(F.col("text"), patterns))


def prepare_hook(messages: DataFrame, config: FilterConfig = FilterConfig(), patterns: Sequence[str] | None = None) -> DataFrame:
    """A hook's messages ``(role, text)``: shorten, redact, then filter strictly."""
    short = messages.withColumn("text", redact(summarize(F.col("text"), F.col("role")), patterns))
    return decide(short, source="hook", config=config).where("store").withColumnRenamed("score", "importance_score").drop("store", "reason")


def admit(candidates: DataFrame, existing: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Candidates that no existing memory comes close to."""
    return gate.duplicate_gate(candidates, existing, threshold).where("ok").drop("ok", "reason", "similar_memory")
