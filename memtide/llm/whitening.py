"""Whitening of vectors by a tall and skinny QR, without a covariance matrix.

The fit list is every distinct integer vector once. Its rows are centred with exact integer sums, each task factorises its
own rows batch by batch and keeps the triangle, and triangles are stacked and factorised again, at most ``FAN`` at a time, up
a tree. The last triangle R has the singular values s and right vectors of all centred rows, so the covariance of n rows
has the eigenvalues s^2 / n and those vectors: nothing is squared on the way, which keeps the small directions right.
Squares of lengths that a long cannot hold have no deviation (null).

Rows are left out as :func:`memtide.llm.vectors.integer_rows` says; repeated rows count once in the fit and each gets its
values, null ids too. A direction without variance (singular value below the largest's rounding error) can't be whitened
and has no rows, so one distinct vector, or none, has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize
from memtide.llm.vectors import as_longs, exact, int_lists, integer_rows, largest, matrix
from memtide.llm.workers import frugal

#: Triangles that a task of the tree stacks; each has dim^2 numbers.
FAN = 16
ROWS = 4096


@dataclass
class Whitener:
    """``n`` distinct rows whose sums are ``sums``; unit ``vectors`` by row with falling ``values`` of variance, of ``total``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is taken off in integers, so nothing cancels."""
        return (x - np.array([s // self.n for s in self.sums], np.int64)) - np.array([s % self.n / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sums)^2, whole."""
        top = self.n * largest(x) + max((abs(s) for s in self.sums), default=0)
        kind = exact(max(1, x.shape[1]) * top * top)
        kind = np.int64 if kind is np.float64 else kind
        apart = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return (apart * apart).sum(axis=1)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + matrix(batch.column(0), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), int_lists(sums[None, :])], names=["n", "s"])

    each = fit.mapInArrow(run, "n bigint, s array<bigint>")
    each = each.select(F.posexplode(F.concat(F.array("n"), "s")).alias("d", "s")).groupBy("d").agg(F.sum("s").alias("s"))
    told = {r["d"]: r["s"] for r in each.collect()}  # a number a dimension
    return told.get(0, 0), [told.get(d + 1, 0) for d in range(dim)]


def tsqr(fit: DataFrame, dim: int, white: Whitener) -> np.ndarray:
    """The triangle of all centred rows of ``fit(x)``."""
    sent = fit.sparkSession.sparkContext.broadcast(white)

    @frugal
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = matrix(batch.column(0).slice(at, ROWS), dim)
                r = triangle(np.vstack([r, sent.value.centred(some)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["node", "r"])

    def merge(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.vstack([np.asarray(x).reshape(-1, dim) for x in some.sort_values("node")["r"]]))
        return pd.DataFrame({"node": [key[0]], "r": [r.ravel()]})

    r = materialize(fit.mapInArrow(leaf, "node bigint, r array<double>"), "triangles")
    nodes = (r.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        r = r.groupBy(F.floor(F.col("node") / FAN).alias("up")).applyInPandas(merge, "node bigint, r array<double>")
        nodes = -(-nodes // FAN)
    top = r.collect()  # one triangle
    return np.array(top[0]["r"]).reshape(-1, dim) if top else np.zeros((0, dim))


def fit_whitener(fit: DataFrame, dim: int, components: int) -> Whitener | None:
    """Of the distinct integer rows ``fit(x)``; None if nothing varies."""
    n, sums = _sums(fit, dim) if dim else (0, [])
    if not n:
        return None
    white = Whitener(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0)
    r = tsqr(fit, dim, white)
    _, s, right = np.linalg.svd(r, full_matrices=False)
    real = np.flatnonzero(s > s[:1].max(initial=0.0) * max(dim, 1) * np.finfo(float).eps)[:components]
    if not len(real):
        return None
    right = right[real]
    turn = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])
    return Whitener(n, sums, right * turn[:, None], s[real] ** 2 / n, float((s**2).sum() / n))


def identity_error(fit: DataFrame, dim: int, white: Whitener) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity, measured over all of it."""
    sent = fit.sparkSession.sparkContext.broadcast(white)
    m = len(white.values)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for batch in batches:
            w = sent.value.apply(matrix(batch.column(0), dim))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m, dtype=np.int32)), pa.array(total.ravel())], names=["i", "s"])

    told = fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros(m * m)
    for row in told:
        cov[row["i"]] = row["s"] / white.n
    return float(np.abs(cov.reshape(m, m) - np.eye(m)).max())


WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every row that is left."""
    rows, dim = integer_rows(df, column, scale, id)
    fit = materialize(rows.select("x").distinct(), "fit_list")
    white = fit_whitener(fit, dim, components)
    if white is None:
        return df.sparkSession.createDataFrame([], WHITENED)
    off, m = identity_error(fit, dim, white), len(white.values)
    sent = df.sparkSession.sparkContext.broadcast(white)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x, k = matrix(some.column("x"), dim), some.num_rows
                far = white.deviations(x)
                far = pa.array([v if v < 2**63 else None for v in far], pa.int64()) if far.dtype == object else pa.array(as_longs(far))
                each = pa.array(np.repeat(np.arange(k), m))
                same = lambda v, kind: pa.array(np.full(k * m, v), kind)
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), same(white.n, pa.int64()), far.take(each), pa.array(white.apply(x).ravel()), pa.array(np.tile(white.values / white.total, k)), same(off, pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col(id).cast("bigint").alias("vec_id"), "x").mapInArrow(run, WHITENED)
