"""Vectors as short codes: each of a few parts is told by the nearest entry of the part's codebook.

Equal integer parts at a position are one row with a weight, so what is learned from is the distinct parts. A round of
weighted Lloyd sends the codebooks (parts * codes rows, whatever the input) to the tasks; each task adds up its own rows by
entry, Spark adds up the tasks, and the driver gets a row an entry. Last, codes and errors are joined back to the vectors.
All numbers are whole, so sums and ties are exact and the result does not depend on how rows are dealt.

Rows are left out as :func:`memtide.llm.vectors.integer_rows` says. Ids may repeat or be null: every row gets its code, and
of first entries equal ids go by vector, null ids last. Fewer than ``codes`` rows make as many entries as there are rows.
A length that ``parts`` does not divide is cut as evenly as can be. An error beyond a long counts as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize
from memtide.llm.vectors import as_longs, exact, int_lists, integer_rows, largest, matrix, meet
from memtide.llm.workers import frugal

#: Rows whose distances to all entries are held at once.
ROWS = 4096


def _total(errors: str) -> Column:
    return F.least(F.sum(F.col(errors).cast("decimal(19,0)")), F.lit(2**63 - 1)).cast("bigint")


@dataclass
class Codes:
    """``rows``: ``(rid, id, label, codes array<int>, error long)``; ``books``: a matrix of entries for each part."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        told = ",".join(str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(told.encode()).hexdigest()


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and the squared distance to it, exactly."""
    kind = exact(4 * max(1, values.shape[1]) * max(largest(values), largest(book), 1) ** 2)
    v, b = values.astype(kind), book.astype(kind)
    found, far = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    own = (b * b).sum(axis=1)
    for at in range(0, len(v), ROWS):
        some = v[at : at + ROWS]
        apart = own[None, :] - 2 * (some @ b.T)
        found[at : at + ROWS] = best = apart.argmin(axis=1)
        far[at : at + ROWS] = as_longs((some * some).sum(axis=1) + apart[np.arange(len(some)), best])
    return found, far


def _of_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A part's number, its places in the batch and its values."""
    part = batch.column("part").to_numpy()
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        column = batch.column("v").take(pa.array(at))
        width = len(column[0])
        yield int(p), at, matrix(column, width)


def _lloyd(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each used entry becomes the floored mean of its parts."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        sums, n = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, at, values in _of_parts(batch):
                code, _ = nearest(values, books[p])
                np.add.at(sums[p], code, values * weight[at][:, None])
                np.add.at(n[p], code, weight[at])
        for p, counts in enumerate(n):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used]), int_lists(sums[p][used])], names=["part", "entry", "n", "s"])

    each = distinct.mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    each = each.select("part", "entry", F.posexplode(F.concat(F.array("n"), "s")).alias("d", "s")).groupBy("part", "entry", "d").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s"))
    moved = [b.copy() for b in books]
    told = each.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("s")).collect()  # an entry has one number a dimension
    for row in told:
        n, *sums = [int(x["s"]) for x in row["s"]]
        moved[row["part"]][row["entry"]] = [x // n for x in sums]
    sent.destroy()
    return moved


def _assign(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, values in _of_parts(batch):
                code[at], error[at] = nearest(values, sent.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=["part", "v", "weight", "code", "error"])

    return distinct.mapInArrow(run, "part int, v array<int>, weight bigint, code int, error bigint")


def compress(df: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 4, codes: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Codes and squared errors of all vectors of ``df``, and the codebooks learned from all of them."""
    rows, dim = integer_rows(df, column, scale, id, label)
    ends = [dim * p // parts for p in range(parts + 1)]
    cuts = F.array(*(F.slice("x", low + 1, high - low) for low, high in zip(ends, ends[1:], strict=False)))
    pieces = rows.select("rid", F.col(id).alias("id"), F.col(label).alias("label"), F.posexplode(cuts).alias("part", "v"))
    distinct = materialize(pieces.groupBy("part", "v").agg(F.count("*").alias("weight")), "parts")
    first = rows.orderBy(F.col(id).asc_nulls_last(), "x").limit(codes).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim)
    books = [start[:, low:high].copy() for low, high in zip(ends, ends[1:], strict=False)]
    for _ in range(rounds if len(first) else 0):
        books = _lloyd(distinct, books)
    told = materialize(_assign(distinct, books), "codes")
    each = meet(pieces, told, ["part", "v"], "weight", rows.count())
    whole = each.groupBy("rid", "id", "label").agg(F.array_sort(F.collect_list(F.struct("part", "code"))).alias("c"), _total("error").alias("error"))  # a row a part
    return Codes(whole.select("rid", "id", "label", F.col("c.code").alias("codes"), "error"), books)


def digests(found: Codes) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: what the query returns of each vector."""
    rows = materialize(found.rows.select(F.col("id").alias("vec_id"), "label", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error"), "vector_codes")
    by_label = materialize(rows.groupBy("label").agg(_total("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    met = meet(rows, by_label, ["label"], "n", rows.count(), nulls=True)
    return met.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _oracle(parts: int = 4, codes: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The query in SQL, a pair of tables a round; squared distances of whole numbers are exact in doubles."""
    said = f"""with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
cut as materialized (select vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] as v from kept, (select unnest(range({parts})) as p)),
part as materialized (select p, v, count(*) as w from cut group by all),
book0 as materialized (select p, vec_rank as e, v from cut join (select vec_id, row_number() over (order by vec_id) - 1 as vec_rank from kept) using (vec_id) where vec_rank < {codes})"""
    for i in range(rounds + 1):
        said += f""",
near{i} as materialized (
  select p, v, w, e, d + list_dot_product(v, v) as far from (
    select part.p, part.v, any_value(w) as w, arg_min(e, (b2 - 2 * list_dot_product(part.v, b.v)) * {codes} + e) as e, min(b2 - 2 * list_dot_product(part.v, b.v)) as d
    from part join (select *, list_dot_product(v, v) as b2 from book{i}) b on part.p = b.p group by part.p, part.v))"""
        if i < rounds:
            said += f""",
sum{i} as materialized (select p, e, d, sum(w * x)::bigint as s, sum(w)::bigint as n from (select p, e, w, unnest(v) as x, unnest(range(len(v))) as d from near{i}) group by all),
book{i + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from book{i} b left join (select p, e, list(floor(s / n::double) order by d) as v from sum{i} group by all) m on m.p = b.p and m.e = b.e)"""
    return (
        said
        + f""",
whole as materialized (
  select vec_id, any_value(label) as label, string_agg(lower(lpad(hex(e::bigint), 2, '0')), '' order by cut.p) as code, sum(far)::bigint as error
  from cut join near{rounds} n on n.p = cut.p and n.v = cut.v group by vec_id),
told as (select sha256(string_agg(x::bigint::varchar, ',' order by p, e, d)) as s from (select p, e, unnest(v) as x, unnest(range(len(v))) as d from book{rounds}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, s as codebooks_sha256 from whole, told"""
    )


ORACLE = _oracle()
