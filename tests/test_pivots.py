"""Searches with pivots against all products."""

from __future__ import annotations

import numpy as np
import pytest

from memtide.operators import pivots, retrieval


def clustered(n: int, dim: int, seed: int) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    return centres[rnd.integers(0, 12, n)] + rnd.normal(scale=0.15, size=(n, dim))


@pytest.fixture(scope="module")
def tables(spark):
    x = clustered(900, 12, 3)
    x[100:400] = x[50]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [1.0, 2.0])]
    asked = [(i, x[i].tolist()) for i in range(0, 900, 30)] + [(5000, [0.0] * 12), (5001, None), (5002, (-x[7]).tolist()), (5003, [1.0])]
    return spark.createDataFrame(asked, "query_id bigint, embedding array<double>"), spark.createDataFrame(rows, "pos bigint, embedding array<double>").repartition(3), x


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q)), 9)


@pytest.mark.parametrize("threshold", [0.95, 0.5, -1.0])
def test_matches_are_those_of_all_products(tables, threshold: float) -> None:
    queries, rows, x = tables
    found, saved = pivots.pivot_matches(queries, pivots.build_pivots(rows, 10, 200), threshold)
    want = {(i, int(p)) for i in range(0, 900, 30) for p in np.flatnonzero(cosines(x, x[i]) >= threshold)} | {(5002, int(p)) for p in np.flatnonzero(cosines(x, -x[7]) >= threshold)}
    assert {(r["query_id"], r["pos"]) for r in found.collect()} == want
    told = saved.first()
    assert told["products"] == 900 * 31 and (told["skipped"] > 0.5 * told["products"] if threshold == 0.95 else told["skipped"] >= 0)


@pytest.mark.parametrize(("k", "sample"), [(5, 200), (5, 3), (400, 500)])
def test_top_is_that_of_all_products(tables, monkeypatch, k: int, sample: int) -> None:
    monkeypatch.setattr(pivots, "MAX_CELLS", 12 * 20)
    queries, rows, x = tables
    monkeypatch.setattr(pivots, "MAX_CELLS", 4_000_000) if sample == 500 else None
    found, saved = pivots.pivot_top(queries, pivots.build_pivots(rows, 10, sample), k)
    got = {}
    for r in retrieval.truncate(found, k, keep="rank").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["pos"]
    for i in range(0, 900, 30):
        s = cosines(x, x[i])
        assert [got[i][n] for n in sorted(got[i])] == sorted(range(900), key=lambda p: (-s[p], p))[:k]
    assert set(got) == {*range(0, 900, 30), 5002}
    if sample == 200:
        assert saved.first()["skipped"] > 0


@pytest.mark.parametrize("threshold", [0.95, 0.3])
def test_nearest_is_the_earliest_of_the_best(tables, threshold: float) -> None:
    queries, rows, x = tables
    found, saved = pivots.pivot_nearest(queries, pivots.build_pivots(rows, 10, 200), threshold)
    best = {}
    for r in found.collect():
        best[r["query_id"]] = max(best.get(r["query_id"], (-2.0, 0)), (r["score"], -r["pos"]))
    want = {}
    for i, q in [*((i, x[i]) for i in range(0, 900, 30)), (5002, -x[7])]:
        s = cosines(x, q)
        p = min(range(900), key=lambda p: (-s[p], p))
        if s[p] >= threshold:
            want[i] = (s[p], -p)
    assert best == want and saved.first()["skipped"] > 0 and found.count() <= 31 * rows.sparkSession.sparkContext.defaultParallelism * 4


def test_pivots_of_nothing(spark, tables) -> None:
    queries, rows, _ = tables
    empty = pivots.build_pivots(rows.limit(0))
    assert pivots.pivot_top(queries, empty, 3)[0].count() == 0 and pivots.pivot_matches(queries.limit(0), pivots.build_pivots(rows), 0.5)[0].count() == 0
