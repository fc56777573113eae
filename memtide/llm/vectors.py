"""Vectors as rows of whole numbers, shared by the operators that need exact sums, products or equality of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize

#: A row of a table that weighs at least one in so many goes to every task, so there are at most as many such rows.
HOT = 1000
_LOW, _HIGH = -(2**31), 2**31 - 1


def integer_rows(df: DataFrame, column: str, scale: int, *carry: str) -> tuple[DataFrame, int]:
    """A written table ``(rid, *carry, x array<int>)`` with x = floor(scale * component as double), and the vectors' length.

    ``rid`` numbers rows, as ids may repeat or be null. Rows whose vector is null, empty, or holds a null or non-finite
    component are left out, and so are those of another length than the commonest (of ties the longest). A number beyond
    32 bits counts as the nearest end of that range. Without a row the length is 0.
    """
    v = F.col(f"`{column}`")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(v, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(_HIGH)), F.lit(_LOW)).cast("int"))
    rows = df.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.monotonically_increasing_id().alias("rid"), *(F.col(f"`{c}`") for c in carry), whole.alias("x"))
    rows = materialize(rows, "integer_rows")
    longest = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = longest["d"] if longest else 0
    return rows.where(F.size("x") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def int_lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(values.astype(np.int64).ravel()))


def largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def exact(bound: int) -> type:
    """The fastest type that holds whole numbers up to ``bound`` exactly: doubles have the fast product of matrices."""
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def as_longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any type as longs, those beyond as the nearest end."""
    if values.dtype == object:
        values = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in values.ravel()], dtype=np.int64).reshape(values.shape)
    return values.astype(np.int64)


def meet(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, nulls: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, a written one with a row a key. ``weight``: how many rows have the key; ``nulls``: they
    are equal.

    Keys that a thousandth of all ``total`` rows have, or more, are sent to every task, so none of them meets in one;
    only the others are shuffled.
    """
    named = table.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in table.columns if c not in keys))
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_{k}")) if nulls else F.col(k) == F.col(f"_{k}")
        same = equal if same is None else same & equal
    often = F.col(weight) * HOT >= total
    hot, rest = F.broadcast(named.where(often)), named.where(~often)
    met = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(rest, same))
    return met.drop(*(f"_{k}" for k in keys))
