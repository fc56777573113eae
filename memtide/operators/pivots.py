"""Exact cosine searches that skip rows by the triangle inequality of angles.

A few pivots are spread over a bounded sample of the rows; every row then goes to the pivot nearest to it. The index holds the
rows in ranges of pivot and angle to it, so that a stretch of neighbouring rows has one pivot and a narrow span of angles.
With b the angle from a query to the pivot and [low, high] the stretch's span, no row of the stretch is nearer to the query
than max(b - high, low - b). Where the cosine of that is below what the query needs, the stretch is not multiplied. A query
needs a threshold, or for the best k the k-th best cosine among the sample; both are exact, as the sample's rows are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.operators.matrix import MAX_CELLS, SCORED, unit_rows
from memtide.plans.lineage import cut

#: Rows of the sample at most, and pivots drawn from it.
SAMPLE = 4096
PIVOTS = 64
#: Rows of a stretch.
STRETCH = 256
#: Queries that are multiplied with a stretch at once: 8 MB of cosines.
COLUMNS = 4096
SLACK = 1e-7


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim))


def spread_out(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows of unit vectors, each the farthest from those before it."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break  # all others are copies
        chosen.append(far)
        near = np.maximum(near, sample @ sample[far])
    return sample[chosen]


@dataclass(frozen=True)
class PivotIndex:
    """``rows(pos, embedding, pivot, angle)``, written in ranges of pivot and angle."""

    rows: DataFrame
    dim: int
    sample: np.ndarray
    pivots: np.ndarray


def build_pivots(rows: DataFrame, k: int = PIVOTS, sample: int = SAMPLE) -> PivotIndex:
    """The index of ``rows(pos, embedding)``. Null and zero vectors match nothing and are left out, as are vectors of another
    length than the sample's first. The sample is the rows with the smallest hashes of ``pos``."""
    spark = rows.sparkSession
    vectors = rows.select(F.col("pos").cast("bigint").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and exists(embedding, x -> x <> 0)")
    drawn = vectors.orderBy(F.xxhash64("pos"), "pos").limit(sample).toArrow()
    if not drawn.num_rows:
        return PivotIndex(vectors.selectExpr("pos", "embedding", "0 as pivot", "0.0d as angle"), 0, np.zeros((0, 0)), np.zeros((0, 0)))
    lists = drawn.column("embedding").combine_chunks()
    dim = len(lists[0])
    same = np.flatnonzero(lists.value_lengths().to_numpy() == dim)[: max(1, MAX_CELLS // dim)]
    known = _rows(lists.take(pa.array(same)), dim)
    pivots = spread_out(known, k)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _rows(batch.column(1), dim) @ sent.value.T
            best = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angle)], names=["pos", "embedding", "pivot", "angle"])

    placed = vectors.where(F.size("embedding") == dim).mapInArrow(assign, "pos bigint, embedding array<double>, pivot int, angle double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return PivotIndex(cut(placed.repartitionByRange(parts, "pivot", "angle", "pos").sortWithinPartitions("pivot", "angle", "pos")), dim, known, pivots)


def _searched(queries: DataFrame, index: PivotIndex, k: int | None, threshold: float | None, best: bool = False) -> DataFrame:
    """``SCORED`` rows that reach what their query needs, with ``best`` only the best of each query and task, which then is
    what the query needs; and a row a task and block with ``query_id`` null, the number of
    products in ``pos`` and of those skipped in ``score``."""
    spark, dim = index.rows.sparkSession, index.dim
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    n = asked.count() if dim else 0
    blocks, found = -(-n * dim // MAX_CELLS), None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        table = part.toArrow()  # about MAX_CELLS numbers
        if not table.num_rows:
            continue
        q = _rows(table.column("embedding").combine_chunks(), dim)
        if k is None:
            need = np.full(len(q), threshold)
        else:
            need = np.full(len(q), -2.0)
            for at in range(0, len(q), 1024):
                if len(index.sample) >= k:
                    need[at : at + 1024] = np.partition(q[at : at + 1024] @ index.sample.T, -k, axis=1)[:, -k]
        sent = spark.sparkContext.broadcast((table.column("query_id").to_numpy(), q, need, np.arccos(np.clip(q @ index.pivots.T, -1, 1))))

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            ids, q, need, to_pivot = sent.value
            need, top, where = need.copy(), np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
            # What is below this angle can reach what is needed.
            reach = np.arccos(np.clip(need - SLACK, -1, 1))
            products = skipped = 0
            for batch in batches:
                pivot, angle = batch.column("pivot").to_numpy(), batch.column("angle").to_numpy()
                edges = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]).tolist() + [batch.num_rows] if batch.num_rows else [0]
                for start, end in zip(edges, edges[1:], strict=False):
                    for at in range(start, end, STRETCH):
                        here = slice(at, min(at + STRETCH, end))
                        low, high = angle[here].min(), angle[here].max()
                        b = to_pivot[:, pivot[at]]
                        live = np.flatnonzero(np.maximum(b - high, low - b) <= reach + SLACK)
                        size = here.stop - at
                        products, skipped = products + size * len(ids), skipped + size * (len(ids) - len(live))
                        if not len(live):
                            continue
                        left, pos = _rows(batch.column("embedding").slice(at, size), dim), batch.column("pos").slice(at, size).to_numpy()
                        if best:
                            order = np.argsort(pos, kind="stable")
                            left, pos = left[order], pos[order]
                        for some in (live[i : i + COLUMNS] for i in range(0, len(live), COLUMNS)):
                            scores = left @ q[some].T
                            np.round(scores, 9, out=scores)
                            if best:
                                r = scores.argmax(axis=0)
                                most = scores[r, np.arange(len(some))]
                                better = (most > top[some]) | ((most == top[some]) & (pos[r] < where[some]))
                                top[some[better]], where[some[better]] = most[better], pos[r[better]]
                                need[some] = np.maximum(need[some], top[some])
                                reach[some] = np.arccos(np.clip(need[some] - SLACK, -1, 1))
                                continue
                            r, j = np.nonzero(scores >= need[some] - SLACK)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[some[j]]), pa.array(pos[r]), pa.array(scores[r, j])], names=["query_id", "pos", "score"])
            found = np.flatnonzero(top > -np.inf)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(where[found]), pa.array(top[found])], names=["query_id", "pos", "score"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([products]), pa.array([float(skipped)])], names=["query_id", "pos", "score"])

        some = cut(index.rows.mapInArrow(run, SCORED))
        found = some if found is None else found.unionByName(some)
    return found if found is not None else spark.createDataFrame([], SCORED)


def pivot_matches(queries: DataFrame, index: PivotIndex, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(query_id, pos, score)`` of all rows that reach ``threshold``; and what :func:`saved` says."""
    found = _searched(queries, index, None, threshold)
    return found.where((F.col("query_id").isNotNull()) & (F.col("score") >= threshold)), saved(found)


def pivot_nearest(queries: DataFrame, index: PivotIndex, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(query_id, pos, score)``: each task's best row of a query, the earliest of ties, if it reaches ``threshold``; and what
    :func:`saved` says. A row a query and task is all that moves."""
    found = _searched(queries, index, None, threshold, best=True)
    return found.where((F.col("query_id").isNotNull()) & (F.col("score") >= threshold)), saved(found)


def pivot_top(queries: DataFrame, index: PivotIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """``(query_id, pos, score)``: a superset of each query's ``k`` best rows, to be cut by the caller; and what
    :func:`saved` says."""
    found = _searched(queries, index, k, None)
    return found.where("query_id is not null"), saved(found)


def saved(found: DataFrame) -> DataFrame:
    """One row ``(products, skipped)``: pairs of a query and a row, and those of them that were not multiplied."""
    return found.where("query_id is null").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("products"), F.coalesce(F.sum("score"), F.lit(0.0)).cast("bigint").alias("skipped"))
