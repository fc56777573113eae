"""The prototype matrix: activation, plastic encoding and winner-take-all learning.

Prototypes are a table ``(proto_id, vec, strength, access_count, created_step, last_access_step)`` of a configured, small
number of rows. They are sent to the vectors' tasks as long as they have at most ``MAX_CELLS`` numbers, and joined beyond.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memtide.functions.vec import add, cosine, norm, normalize, scale


@dataclass(frozen=True)
class LearningConfig:
    temperature: float = 1.0
    residual_scale: float = 0.1
    top_k: int | None = None
    base_rate: float = 0.1
    rate_decay: float = 0.01
    decay: float = 0.995
    init_scale: float = 0.01
    max_strength: float = 5.0


#: Numbers in a prototype table that is sent to every task: 32 MB.
MAX_CELLS = 4_000_000


def _cells(protos: DataFrame) -> int:
    return protos.agg(F.sum(F.size("vec"))).first()[0] or 0


def similarities(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """``(id, proto_id, sim)`` of ``vectors(id, embedding)``; a zero vector is similar to nothing."""
    p = protos.select("proto_id", "vec")
    p = F.broadcast(p) if _cells(p) <= MAX_CELLS else p
    return vectors.select("id", "embedding").crossJoin(p).select("id", "proto_id", "vec", cosine(F.col("embedding"), F.col("vec"), "zero").alias("sim"))


def activation_weights(vectors: DataFrame, protos: DataFrame, config: LearningConfig = LearningConfig()) -> DataFrame:
    """Softmax over prototypes; with ``top_k`` the ties at the threshold stay and all others weigh 0."""
    sims = similarities(vectors, protos)
    if config.top_k is not None:
        place = F.rank().over(Window.partitionBy("id").orderBy(F.col("sim").desc()))
        sims = sims.withColumn("e", F.when(place <= config.top_k, F.exp(F.col("sim") / config.temperature)).otherwise(0.0))
    else:
        sims = sims.withColumn("e", F.exp(F.col("sim") / config.temperature))
    return sims.select("id", "proto_id", "vec", "sim", (F.col("e") / F.sum("e").over(Window.partitionBy("id"))).alias("weight"))


def lookup(vectors: DataFrame, protos: DataFrame, config: LearningConfig = LearningConfig()) -> DataFrame:
    """``(id, residual)``: the weighted sum of the prototypes as they are, scaled. A product of matrices a batch."""
    return _weighted(vectors, protos, config, base=False).withColumnRenamed("v", "residual")


def encode(vectors: DataFrame, protos: DataFrame, config: LearningConfig = LearningConfig()) -> DataFrame:
    """``(id, encoding)``: base plus residual."""
    return _weighted(vectors, protos, config, base=True).withColumnRenamed("v", "encoding")


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length; a zero row stays zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def _weighted(vectors: DataFrame, protos: DataFrame, config: LearningConfig, base: bool) -> DataFrame:
    """``(id, v)``, on the vectors' partitions as they are; the sums are those of :func:`activation_weights`."""
    spark, kind = vectors.sparkSession, vectors.select("id").schema["id"].dataType.simpleString()
    if _cells(protos) > MAX_CELLS:
        parts = activation_weights(vectors, protos, config).select("id", F.posexplode(scale(F.col("vec"), F.col("weight"))).alias("d", "x"))
        sums = parts.groupBy("id", "d").agg(F.sum("x").alias("x")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("r"))
        v = scale(F.col("r.x"), config.residual_scale)
        return vectors.join(sums, "id").select("id", (add(F.col("embedding"), v) if base else v).alias("v"))
    rows = protos.select("proto_id", "vec").orderBy("proto_id").collect()  # at most MAX_CELLS numbers
    sent = spark.sparkContext.broadcast(np.array([r["vec"] for r in rows], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            if not batch.num_rows or not len(table):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sims = _unit(x) @ _unit(table).T
            e = np.exp(sims / config.temperature)
            if config.top_k is not None and config.top_k < len(table):
                least = np.partition(np.round(sims, 12), -config.top_k, axis=1)[:, -config.top_k]
                e = np.where(np.round(sims, 12) >= least[:, None], e, 0.0)
            v = (e / e.sum(axis=1, keepdims=True)) @ table * config.residual_scale + (x if base else 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "v"])

    return vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").mapInArrow(run, f"id {kind}, v array<double>")


def nearest(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """``(id, proto_id, sim)`` of the most similar prototype, the lowest id of ties."""
    best = similarities(vectors, protos).groupBy("id").agg(F.max(F.struct("sim", (-F.col("proto_id")).alias("n"))).alias("b"))
    return best.select("id", (-F.col("b.n")).alias("proto_id"), F.col("b.sim").alias("sim"))


Rule = Callable[[np.ndarray, int, np.ndarray, float, LearningConfig], np.ndarray]


def oja(p: np.ndarray, n: int, x: np.ndarray, importance: float, config: LearningConfig) -> np.ndarray:
    """One step of Oja's rule on a prototype that has been updated ``n`` times, back to unit length."""
    y = float(p @ x)
    moved = p + importance * config.base_rate / (1 + n * config.rate_decay) * y * (x - y * p)
    return moved / max(float(np.linalg.norm(moved)), 1e-12)


FOLDED = "proto_id int, _vec array<double>, _n bigint, _s double"


def learn(vectors: DataFrame, protos: DataFrame, step: int = 0, config: LearningConfig = LearningConfig(), decay: bool = True, rule: Rule = oja, assigned: DataFrame | None = None) -> DataFrame:
    """``vectors(id, embedding[, importance])`` -> the new prototype table. ``rule`` makes the new vector of one update.
    ``assigned`` is :func:`nearest` of the rows, if the caller has it.

    Rows are assigned against the matrix before the batch and then fold, in order of id, into their prototype; updates of
    different prototypes don't touch. Decay follows once. The rows of a prototype are streamed, so a popular one takes no
    more memory than another.
    """
    rows = vectors if "importance" in vectors.columns else vectors.withColumn("importance", F.lit(1.0))
    mine = (nearest(rows, protos) if assigned is None else assigned).select("id", F.col("proto_id").cast("int").alias("proto_id")).join(rows.select("id", "embedding", "importance"), "id")
    start = protos.select(F.col("proto_id").cast("int").alias("proto_id"), F.col("vec").cast("array<double>").alias("v"), F.col("access_count").cast("bigint").alias("n"), F.col("strength").cast("double").alias("s"))
    ordered = mine.withColumn("first", F.lit(0)).select("proto_id", "first", "id", F.col("embedding").cast("array<double>").alias("v"), F.col("importance").cast("double").alias("s"), F.lit(0).cast("bigint").alias("n"))
    # A prototype's own row opens its run.
    opened = start.select("proto_id", F.lit(-1).alias("first"), F.lit(None).cast(mine.schema["id"].dataType).alias("id"), "v", "s", "n")
    n_parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ordered.unionByName(opened).repartition(n_parts, "proto_id").sortWithinPartitions("proto_id", "first", "id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, now, state, hit = ["proto_id", "_vec", "_n", "_s"], None, None, False
        for frame in frames:
            done = []
            for proto, first, v, s, n in zip(*(frame[c] for c in ("proto_id", "first", "v", "s", "n")), strict=True):
                if first < 0:
                    done += [(now, *state)] if hit else []
                    now, state, hit = proto, (np.asarray(v, float), int(n), float(s)), False
                    continue
                p, count, strength = state
                state = rule(p, count, np.asarray(v, float), float(s), config), count + 1, min(strength + 1 / (1 + 0.2 * count), config.max_strength)
                hit = True
            yield pd.DataFrame(done, columns=names)
        if hit:
            yield pd.DataFrame([(now, *state)], columns=names)

    moved = runs.mapInPandas(fold, FOLDED)
    new = protos.join(moved, "proto_id", "left")
    hit, k = F.col("_n").isNotNull(), config.decay if decay else 1.0
    vec = F.coalesce("_vec", F.col("vec").cast("array<double>"))
    return new.select("proto_id", scale(vec, k).alias("vec"), (F.coalesce("_s", F.col("strength").cast("double")) * k).alias("strength"), F.coalesce("_n", F.col("access_count").cast("bigint")).alias("access_count"), F.when(hit & (F.col("created_step") < 0), F.lit(step)).otherwise(F.col("created_step")).alias("created_step"), F.when(hit, F.lit(step)).otherwise(F.col("last_access_step")).alias("last_access_step"))


def decayed(protos: DataFrame, steps: int = 1, factor: float = 0.995) -> DataFrame:
    k = factor**steps
    return protos.withColumns({"vec": scale(F.col("vec"), k), "strength": F.col("strength") * k})


def capacity_usage(protos: DataFrame, init_scale: float = 0.01) -> DataFrame:
    return protos.agg(F.avg((norm(F.col("vec")) > 3 * init_scale).cast("double")).alias("capacity_usage"))


def learn_report(assigned: DataFrame, protos: DataFrame, init_scale: float = 0.01) -> DataFrame:
    """One row of what a batch of learning did: rows seen, distinct prototypes hit, and the share of prototypes in use.

    ``assigned``: :func:`nearest` of the batch before the update; ``protos``: the table after it.
    """
    hit = assigned.agg(F.count("*").alias("updated"), F.count_distinct("proto_id").alias("unique_updated"))
    return hit.crossJoin(capacity_usage(protos, init_scale))


def initial(spark: SparkSession, k: int, dim: int, seed: int = 0) -> DataFrame:
    """A fresh prototype table: ``k`` directions drawn evenly, at unit length, the same for the same seed.

    Each number is a normal one made from two hashes of its place (Box and Muller), so the table is the same on any cluster.
    """
    place = lambda salt: (F.pmod(F.xxhash64("id", F.col("d"), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cells = spark.range(k).select("id", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    cells = cells.withColumn("x", F.sqrt(-2 * F.log(place(1))) * F.cos(2 * math.pi * place(2)))
    rows = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("r"))
    fresh = F.lit(-1)
    return rows.select(F.col("id").cast("int").alias("proto_id"), normalize(F.col("r.x")).alias("vec"), F.lit(1.0).alias("strength"), F.lit(0).cast("bigint").alias("access_count"), fresh.alias("created_step"), fresh.alias("last_access_step"))
