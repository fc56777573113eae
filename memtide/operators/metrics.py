"""Evaluation: grouped hit rates, set hits, residual norms, and the learning suites."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.functions.vec import norm
from memtide.operators import markov, prototypes
from memtide.plans.lineage import cut


def grouped_metrics(results: DataFrame, by: str = "question_type", recall: str = "recall_hit", qa: str = "qa_hit") -> DataFrame:
    """Overall and by type: count and hit rates, rounded to four places; ``scope`` is ``overall`` or ``by_type``."""
    rolled = results.rollup(by).agg(F.grouping(by).alias("g"), F.count("*").alias("n"), F.round(F.avg(F.col(recall).cast("double")), 4).alias("recall_at_k"), F.round(F.avg(F.col(qa).cast("double")), 4).alias("qa_accuracy"))
    return rolled.select(F.when(F.col("g") == 1, "overall").otherwise("by_type").alias("scope"), F.col(by), "n", "recall_at_k", "qa_accuracy")


def set_hits(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """``(question_id, session_ids)`` twice -> whether they share one."""
    g = gold.select("question_id", F.col("session_ids").alias("_g"))
    return retrieved.join(g, "question_id").select("question_id", F.coalesce(F.arrays_overlap("session_ids", "_g"), F.lit(False)).alias("recall_hit"))


def contains_judge(answer: F.Column, expected: F.Column) -> F.Column:
    """The judge without a model: one text contains the other."""
    a, b = F.lower(F.trim(answer)), F.lower(F.trim(expected))
    return F.contains(a, b) | F.contains(b, a)


def residual_norm(vectors: DataFrame, protos: DataFrame, config: prototypes.LearningConfig) -> DataFrame:
    return prototypes.lookup(vectors, protos, config).agg(F.avg(norm(F.col("residual"))).alias("residual_norm"))


def embedding_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean L2 distance of two encodings ``(id, encoding)``."""
    b = after.select("id", F.col("encoding").alias("_b"))
    gap = F.zip_with("encoding", "_b", lambda x, y: x - y)
    return before.join(b, "id").agg(F.avg(norm(gap)).alias("shift"))


def forgetting_suite(protos: DataFrame, steps: int = 100, factor: float = 0.995) -> DataFrame:
    """Share of strength left after ``steps`` of decay."""
    before = protos.agg(F.avg("strength").alias("b"))
    return prototypes.decayed(protos, steps, factor).agg(F.avg("strength").alias("a")).crossJoin(before).select((F.col("a") / F.col("b")).alias("strength_ratio"))


def convergence_suite(vectors: DataFrame, protos: DataFrame, iterations: int, config: prototypes.LearningConfig) -> DataFrame:
    """Residual norm before and after ``iterations`` of learning the same batch; each step cuts lineage."""
    now = protos
    for step in range(iterations):
        now = cut(prototypes.learn(vectors, now, step, config))
    return residual_norm(vectors, protos, config).select(F.col("residual_norm").alias("before")).crossJoin(residual_norm(vectors, now, config).select(F.col("residual_norm").alias("after")))


def latency_suite(encode: Callable[[], DataFrame], base: Callable[[], DataFrame], runs: int = 3) -> dict[str, float]:
    """Mean seconds of two plans, each run to the end without keeping its rows, after one warm-up."""
    out = {}
    for name, make in (("encode", encode), ("base", base)):
        make().write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        for _ in range(runs):
            make().write.format("noop").mode("overwrite").save()
        out[name] = (time.perf_counter() - began) / runs
    return out | {"ratio": out["encode"] / out["base"]}


def prediction_suite(edges: DataFrame, pairs: DataFrame, n_items: int) -> DataFrame:
    """Top-1 accuracy of the predicted successor, and the mean surprise of what came."""
    best = markov.predict_next(edges).select("prev", F.col("next").alias("guess"))
    hit = pairs.join(best, "prev", "left").agg(F.avg(F.coalesce(F.col("next") == F.col("guess"), F.lit(False)).cast("double")).alias("top1"))
    return hit.crossJoin(markov.surprise(edges, pairs, n_items).agg(F.avg("surprise").alias("mean_surprise")))


#: What the suites must reach, as (name, least value).
PASS_MARKS = (("strength_ratio", 0.6), ("top1", 0.4), ("residual_gain", 0.0))


def verdicts(values: dict[str, float]) -> dict[str, bool]:
    """Which of the measured values reach their mark."""
    return {name: values[name] >= least for name, least in PASS_MARKS if name in values}


def write_report(metrics: DataFrame, path: str) -> None:
    """The metrics as one JSON file, a line a group."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
