"""Exact top-k inner products by buckets of equal lengths.

Candidates are dealt into cells by falling length. A query keeps the k-th best score that it knows of as a threshold: first
from the longest few rows, then from round to round, in each of which cells with ``GROWTH`` times as many rows as before are
searched. The score that a query still needs, over its own length and a cell's largest, is a cosine: above 1 the query is not
sent to the cell. In a cell, buckets of neighbouring lengths are pruned the same way, each by its own threshold. Where the
cosine is ``STEEP`` or more, few directions come into question, and the bucket's list sorted by one of the query's strongest
coordinates gives the candidates, those in the arc that the cosine leaves (coordinate pruning); else its rows that are long
enough are (length pruning). Candidates are verified by exact products, and thresholds rise as buckets are done.

A cell has at most some ``CELL_ROWS`` rows and is held by one task; queries stream past it. Rows of equal length are dealt by a
hash, so copies don't meet in one cell. Every pair is pruned by a bound or verified; none is dropped.

Rows are left out as :func:`memtide.llm.vectors.integer_rows` says. A query row finds every row but itself; rows that share an
id are different rows, and a query id that stands on two rows has two lists. Null ids are candidates, last of ties, and no
queries. Scores beyond a long count as its nearest end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize
from memtide.llm.vectors import as_longs, exact, int_lists, integer_rows, largest, matrix
from memtide.llm.workers import frugal

SEED_ROWS = 4096
CELL_ROWS = 131_072
#: Queries that a task meets at most with a cell, and those of them held at once.
GROUP_ROWS = 262_144
AT_ONCE = 512
BUCKET_ROWS = 1024
GROWTH = 16
STEEP = 0.9
FOCUS = 3
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min
FOUND = "qrid bigint, query_id bigint, rid bigint, vec_id bigint, score bigint"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T``, exactly, as longs."""
    kind = exact(max(1, a.shape[1]) * largest(a) * largest(b))
    return as_longs(a.astype(kind) @ b.astype(kind).T)


class Bucket:
    """Rows of neighbouring lengths, longest first."""

    def __init__(self, x: np.ndarray, length: np.ndarray) -> None:
        self.x, self.length, self.longest = x, length, float(length[0])
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """By coordinate: rows in the order of their unit vectors' values, and the values."""
        if self._sorted is None:
            unit = self.x / np.where(self.length == 0, 1.0, self.length)[:, None]
            order = unit.argsort(axis=0)
            self._sorted = order, np.take_along_axis(unit, order, axis=0)
        return self._sorted

    def by_coordinate(self, unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and row that unit queries with the needed cosines leave over.

        With angles a to the axis and g = arccos(cosine), a row's own angle lies within a - g and a + g. Of the ``FOCUS``
        strongest coordinates of a query the one with the fewest rows in its arc is taken.
        """
        order, values = self.lists()
        q = len(unit)
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        arc = np.arccos(np.clip(cosine, -1, 1))
        best = np.full(q, len(self.x) + 1)
        start, at = np.zeros(q, np.int64), np.zeros(q, np.int64)
        for j in range(focus.shape[1]):
            for c in np.unique(focus[:, j]):
                some = np.flatnonzero(focus[:, j] == c)
                angle = np.arccos(np.clip(unit[some, c], -1, 1))
                low = np.searchsorted(values[:, c], np.cos(np.minimum(np.pi, angle + arc[some])) - 1e-6, "left")
                high = np.searchsorted(values[:, c], np.cos(np.maximum(0, angle - arc[some])) + 1e-6, "right")
                better = high - low < best[some]
                some, low, high = some[better], low[better], high[better]
                best[some], start[some], at[some] = high - low, low, c
        pairs = np.repeat(np.arange(q), best)
        place = np.arange(len(pairs)) - np.repeat(np.cumsum(best) - best, best)
        return pairs, order[start[pairs] + place, at[pairs]]


class Cell:
    """Candidates of one cell in buckets."""

    def __init__(self, rid: np.ndarray, vec_id: np.ndarray, known: np.ndarray, x: np.ndarray) -> None:
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.rid, self.vec_id, self.known, x, length = rid[order], vec_id[order], known[order], x[order], length[order]
        self.buckets = [(at, Bucket(x[at : at + BUCKET_ROWS], length[at : at + BUCKET_ROWS])) for at in range(0, len(x), BUCKET_ROWS)]

    def search(self, q_rid: np.ndarray, q: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, row, score)``: at most the first ``k`` of each query, none below ``need``; LEAST asks for any score."""
        size = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        unit = q / np.where(size == 0, 1.0, size)[:, None]
        need, held = need.copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for first, bucket in self.buckets:
            reach = size * bucket.longest
            live = np.flatnonzero((need <= 0) | (reach * (1 + SLACK) >= need))
            if not len(live):
                continue
            cosine = np.where(need[live] > 0, need[live] / np.maximum(reach[live], 1.0), -1.0)
            steep = cosine >= STEEP
            for some, pairs in ((live[steep], True), (live[~steep], False)):
                if not len(some):
                    continue
                i, row = bucket.by_coordinate(unit[some], np.minimum(1.0, cosine[steep] * (1 - SLACK))) if pairs else (None, None)
                for part in self._verified(bucket, first, q_rid, q, some, i, row, need, size):
                    held = tuple(np.concatenate(x) for x in zip(held, part, strict=True))
                    held = self._first(*held, k)
            need = self._raised(held[0], held[2], need, k)
        return held

    def _verified(self, bucket: Bucket, first: int, q_rid: np.ndarray, q: np.ndarray, some: np.ndarray, i: np.ndarray | None, row: np.ndarray | None, need: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if i is None:  # length pruning: for the weakest threshold among these queries
            least = np.where(need[some] > 0, need[some] / np.maximum(size[some], 1.0), 0.0).min()
            n = int(np.searchsorted(-bucket.length, -least * (1 - SLACK), "right"))
            scores = products(q[some], bucket.x[:n])
            j, row = np.nonzero(scores >= need[some][:, None])
            parts = [(some[j], row, scores[j, row])]
        else:
            kind = exact(max(1, q.shape[1]) * largest(q) * largest(bucket.x))
            parts = []
            for at in range(0, len(i), 1 << 15):
                j, r = some[i[at : at + (1 << 15)]], row[at : at + (1 << 15)]
                parts.append((j, r, as_longs((q[j].astype(kind) * bucket.x[r].astype(kind)).sum(axis=1))))
        for j, r, score in parts:
            keep = (score >= need[j]) & (self.rid[first + r] != q_rid[j])
            yield j[keep], first + r[keep], score[keep]

    def _first(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.rid[row], self.vec_id[row], ~self.known[row], -score.astype(float), query)) if not len(score) or largest(score) < 2**53 else np.lexsort((self.rid[row], self.vec_id[row], ~self.known[row], ~score, query))
        query, row, score = query[order], row[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = place < k
        return query[keep], row[keep], score[keep]

    @staticmethod
    def _raised(query: np.ndarray, score: np.ndarray, need: np.ndarray, k: int) -> np.ndarray:
        """Queries with ``k`` finds need their last one's score at least. Finds are in order."""
        n = np.bincount(query, minlength=len(need))
        last = np.cumsum(n) - 1
        full = n >= k
        need[full] = np.maximum(need[full], score[last[full]])
        return need


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("vec_id")
    return batch.column("rid").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), matrix(batch.column("x"), dim)


def seeded(queries: DataFrame, rows: DataFrame, dim: int, k: int) -> DataFrame:
    """``queries`` with ``need``: the k-th best score among the ``SEED_ROWS`` longest rows, null where there are fewer."""
    table = rows.orderBy(F.desc("size"), "rid").limit(SEED_ROWS).select("rid", "vec_id", "x").toArrow().combine_chunks()
    seed = _rows(table.to_batches()[0], dim)
    sent = queries.sparkSession.sparkContext.broadcast(seed)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                rid, ids, _, x = _rows(some, dim)
                query, _, score = cell.search(rid, x, np.full(len(x), LEAST), k)
                need = Cell._raised(query, score, np.full(len(x), LEAST), k)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(ids), int_lists(x), some.column("size"), pa.array(need, mask=need == LEAST)], names=["rid", "vec_id", "x", "size", "need"])

    return queries.select("rid", "vec_id", "x", "size").mapInArrow(run, "rid bigint, vec_id bigint, x array<bigint>, size double, need bigint")


def _searched(cells: DataFrame, queries: DataFrame, sizes: list[float], low: int, dim: int, k: int) -> DataFrame:
    """``FOUND`` rows of the cells from ``low`` on, whose largest lengths are ``sizes``."""
    spark = cells.sparkSession
    groups = max(1, -(-queries.count() // GROUP_ROWS))
    reached = F.filter(F.sequence(F.lit(low), F.lit(low + len(sizes) - 1)), lambda i: F.col("need").isNull() | (F.col("need") <= 0) | (F.col("size") * F.get(F.lit(sizes), i - low) * (1 + SLACK) >= F.col("need")))
    asked = queries.withColumn("cell", F.explode(reached)).select("cell", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), "rid", "vec_id", F.col("x").cast("array<int>").alias("x"), "need")
    held = cells.where(F.col("cell").between(low, low + len(sizes) - 1)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("cell", "grp", F.lit(0).alias("kind"), "rid", "vec_id", "x", F.lit(None).cast("bigint").alias("need"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(sizes) * groups, 20_000))
    dealt = held.unionByName(asked).repartition(parts, "cell", "grp").sortWithinPartitions("cell", "grp", "kind")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, cell = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "grp", "kind")])
            ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for low, high in zip(ends, ends[1:], strict=False):
                if low == high:
                    continue
                key, kind = (int(keys[0, low]), int(keys[1, low])), int(keys[2, low])
                if key != now:
                    now, gathered, cell = key, [], None
                some = batch.slice(low, high - low)
                if kind == 0:
                    gathered.append(_rows(some, dim))
                    continue
                if not gathered and cell is None:
                    continue  # a cell without rows
                if cell is None:
                    cell, gathered = Cell(*(np.concatenate(x) for x in zip(*gathered, strict=True))), []
                for at in range(0, some.num_rows, AT_ONCE):
                    part = some.slice(at, AT_ONCE)
                    rid, ids, _, x = _rows(part, dim)
                    need = part.column("need").fill_null(LEAST).to_numpy()
                    query, row, score = cell.search(rid, x, need, k)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[query]), pa.array(ids[query]), pa.array(cell.rid[row]), pa.array(cell.vec_id[row], mask=~cell.known[row]), pa.array(score)], names=["qrid", "query_id", "rid", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def top_products(df: DataFrame, is_query: Column, k: int, id: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest integer products of each row of ``df`` that ``is_query``, a
    condition on ``id``, with all other rows; ties to the smaller id."""
    spark = df.sparkSession
    rows, dim = integer_rows(df, column, scale, id)
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    rows = rows.withColumn("size", size)
    n = rows.count() if dim else 0
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    queries = materialize(seeded(rows.where(is_query & F.col(id).isNotNull()).select("rid", F.col(id).cast("bigint").alias("vec_id"), "x", "size"), rows.select("rid", F.col(id).cast("bigint").alias("vec_id"), "x", "size"), dim, k), "queries")
    wanted = max(-(-n // CELL_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // BUCKET_ROWS)))
    dealt = rows.select("rid", F.col(id).cast("bigint").alias("vec_id"), "x", "size").repartitionByRange(wanted, F.desc("size"), F.xxhash64("rid"))
    cells = materialize(dealt.withColumn("cell", F.spark_partition_id()), "cells")
    told = {r["cell"]: r for r in cells.groupBy("cell").agg(F.max("size").alias("size"), F.count("*").alias("n")).collect()}  # a row a cell
    count = max(told) + 1
    sizes = [told[c]["size"] if c in told else 0.0 for c in range(count)]
    best_first = Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    best, low, done = None, 0, SEED_ROWS
    while low < count:
        high, rows_here = low, 0
        while high < count and (high == low or rows_here + (told[high]["n"] if high in told else 0) <= GROWTH * done):
            rows_here += told[high]["n"] if high in told else 0
            high += 1
        asked = queries
        if best is not None:
            known = best.where(F.col("rank") == k).select(F.col("qrid").alias("rid"), F.col("score").alias("_known"))
            asked = queries.join(known, "rid", "left").withColumn("need", F.greatest("need", "_known")).drop("_known")
        found = _searched(cells, asked, sizes[low:high], low, dim, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k), "best")
        low, done = high, done + rows_here
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with x as materialized (
  select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score from x q join x c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""
