"""The operators on vectors against plain recomputation, with odd rows: nulls, non-finite numbers, ties, repeats, no rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from memtide.llm import innertop, vectorcodes, vectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, rid string, size string, v string, need string"


def odd_vectors(n: int = 330, dim: int = 8, seed: int = 5, spread: float = 0.3) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, spread) * (1 + (i % 5)) for _ in range(dim)], (None, 0, 0, 1)[i % 4]) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, list(same), 0) for i in range(n // 2)]  # a third of all rows
    rows += [(7, list(same), 0), (40, list(rows[3][1]), 1), (None, list(rows[9][1]), None), (None, list(same), 2)]
    rows += [(2000, None, 0), (2001, [None] + [0.1] * (dim - 1), 0), (2002, [math.nan] + [0.1] * (dim - 1), 0), (2003, [math.inf] + [0.1] * (dim - 1), None), (2004, [], 1), (2005, [0.5] * (dim + 1), 1)]
    rows += [(2020, [0.0] * dim, 1), (2040, [-x for x in same], 1), (2060, [x * 3 for x in same], 3)]
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(*r, 1, "r", "s", "v", "n") for r in rows], SCHEMA).repartition(parts)


def whole(rows, scale: int):
    """Rows that take part, in order of id (null last) and vector, with floored components."""
    dims = Counter(len(v) for _, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v))
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    kept = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v), label) for i, v, label in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    return sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plain_codes(rows, parts: int, codes: int, rounds: int, scale: int):
    kept = whole(rows, scale)
    dim = len(kept[0][1])
    cut = lambda x, p: x[dim * p // parts : dim * (p + 1) // parts]
    books = [[cut(x, p) for _, x, _ in kept[:codes]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, x, _ in kept:
                mine[near(cut(x, p), books[p])[1]].append(cut(x, p))
            for e, each in mine.items():
                books[p][e] = tuple(sum(c) // len(each) for c in zip(*each, strict=True))
    out = []
    for i, x, label in kept:
        found = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    sums = defaultdict(int)
    for _, _, error, label in out:
        sums[label] += error
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], sha) for i, code, error, label in out), key=repr)


@pytest.mark.parametrize(("codes", "parts", "dim"), [(16, 4, 8), (256, 4, 8), (8, 3, 7), (4, 4, 3)])
def test_codes_are_those_of_plain_lloyd(spark, codes: int, parts: int, dim: int) -> None:
    rows = odd_vectors(120, dim)
    found = vectorcodes.digests(vectorcodes.compress(frame(spark, rows), parts=parts, codes=codes, rounds=3, scale=64))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_codes(rows, parts, codes, 3, 64)


def test_codes_of_hot_parts_and_labels_meet_by_broadcast_and_the_rest_by_shuffle(spark, monkeypatch) -> None:
    monkeypatch.setattr(vectors, "HOT", 20)
    rows = odd_vectors(120)
    found = vectorcodes.digests(vectorcodes.compress(frame(spark, rows), parts=4, codes=16, rounds=2, scale=64))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_codes(rows, 4, 16, 2, 64)


def test_codes_of_none_and_of_huge_numbers(spark) -> None:
    assert vectorcodes.digests(vectorcodes.compress(frame(spark, []))).count() == 0
    assert vectorcodes.digests(vectorcodes.compress(frame(spark, [(1, None, 1), (2, [math.nan], 1)]))).count() == 0
    far = vectorcodes.compress(frame(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [-1e30, 1.0, 0.0, 0.0], 1)]), codes=1, rounds=0).rows.collect()
    assert {r["id"]: r["error"] for r in far} == {1: 0, 2: 2**63 - 1}


@pytest.mark.parametrize("scale", [2**8, 2**20, 2**31])
def test_nearest_is_exact_at_every_size_of_number(scale: int) -> None:
    rnd = np.random.default_rng(1)
    v, book = rnd.integers(-scale, scale, (50, 4)), rnd.integers(-scale, scale, (9, 4))
    book[4] = book[2]
    code, error = vectorcodes.nearest(v, book)
    for x, c, e in zip(v.tolist(), code, error, strict=True):
        far = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book.tolist()]
        assert (c, e) == (far.index(min(far)), min(2**63 - 1, min(far)))


def whitened_rows(spark, rows, **kw):
    return whitening.whiten(frame(spark, rows, kw.pop("parts", 3)), **kw).collect()


@pytest.mark.parametrize("fan", [2, 16])
def test_whitening_is_that_of_the_covariance(spark, monkeypatch, fan: int) -> None:
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "ROWS", 7)
    rows = odd_vectors()
    kept = whole(rows, 256)
    fit = sorted({x for _, x, _ in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    found = whitened_rows(spark, rows, parts=9)
    assert len(found) == 4 * len(kept)
    by = defaultdict(list)
    for r in found:
        by[r["component"]].append(r)
    for c in range(1, 5):
        e, u = values[-c], turned[:, -c]
        told = {}
        for r in by[c]:
            told.setdefault(r["vec_id"], []).append(r)
        assert {r["n"] for r in by[c]} == {n} and {round(r["explained"], 9) for r in by[c]} == {round(e / values.sum(), 9)}
        assert all(r["identity_error"] < 1e-9 for r in by[c])
        sign = None
        for i, x, _ in kept:
            want = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ u / math.sqrt(e))
            near = min(told[i], key=lambda r: abs(abs(r["whitened"]) - abs(want)))
            assert abs(abs(near["whitened"]) - abs(want)) < 1e-9
            if abs(want) > 1e-6 and len(told[i]) == 1:
                assert sign in (None, near["whitened"] * want > 0)
                sign = near["whitened"] * want > 0
    devs = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x, _ in kept)
    assert Counter((r["vec_id"], r["deviation"]) for r in by[1]) == devs


def test_whitening_without_variance_or_rows(spark) -> None:
    assert whitened_rows(spark, []) == []
    assert whitened_rows(spark, [(1, None, 1), (2, [math.nan, 1.0], 1)]) == []
    assert whitened_rows(spark, [(i, [0.5, 0.25], 1) for i in range(5)]) == []
    line = whitened_rows(spark, [(i, [i / 4, i / 2, 0.0], 1) for i in range(5)])
    assert [r["component"] for r in line] == [1] * 5 and all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in line)


def test_deviation_beyond_a_long_is_null(spark) -> None:
    found = whitened_rows(spark, [(1, [3e6, 0.0], 1), (2, [-3e6, 1.0], 1), (3, [0.0, 0.0], 1)])
    told = {r["vec_id"]: r["deviation"] for r in found if r["component"] == 1}
    fit = [(768000000, 0), (-768000000, 256), (0, 0)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(x, (0, 256), strict=True)) for x in fit]
    assert told == {i + 1: w if w < 2**63 else None for i, w in enumerate(want)}


def plain_top(rows, k: int, every: int, scale: int):
    kept = whole(rows, scale)
    out = []
    for at, (i, q, _) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j or 0) for here, (j, x, _) in enumerate(kept) if here != at)
        out += [(i, r + 1, None if gone else j, -s) for r, (s, gone, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("spread", "k", "steep", "cells"), [(0.3, 5, 0.9, 4096), (0.3, 300, 0.9, 4096), (0.02, 5, -0.5, 16), (1.0, 5, 0.5, 64)])
def test_top_products_are_those_of_all_pairs(spark, monkeypatch, spread: float, k: int, steep: float, cells: int) -> None:
    for name, value in {"SEED_ROWS": 32, "BUCKET_ROWS": 16, "CELL_ROWS": cells, "GROUP_ROWS": 7, "GROWTH": 2, "STEEP": steep, "AT_ONCE": 5}.items():
        monkeypatch.setattr(innertop, name, value)
    rows = odd_vectors(spread=spread)
    found = innertop.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0, k)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_top(rows, k, 20, 64)


def test_top_products_of_few_or_none(spark) -> None:
    top = lambda rows: sorted(map(tuple, innertop.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()))
    assert top([]) == [] and top([(1, [1.0], 1)]) == [] and top([(20, [1.0], 1)]) == [] and top([(20, None, 1)]) == []
    assert top([(20, [1.0], 1), (3, [2.0], 1)]) == [(20, 1, 3, 8192)]
    assert top([(20, [1.0], 1), (20, [2.0], 1)]) == [(20, 1, 20, 8192)] * 2
    assert top([(20, [1e30], 1), (1, [1e30], 1), (2, [-1e30], 1)]) == [(20, 1, 1, (2**31 - 1) ** 2), (20, 2, 2, (2**31 - 1) * -(2**31))]


@pytest.mark.parametrize("steep", [-1.0, 0.9, 2.0])
def test_either_pruning_loses_nothing_and_skips_something(monkeypatch, steep: float) -> None:
    monkeypatch.setattr(innertop, "STEEP", steep)
    rnd = np.random.default_rng(3)
    x = np.floor(64 * rnd.normal(0, 0.3, (3000, 6)) * rnd.lognormal(0, 1, (3000, 1))).astype(np.int64)
    ids = np.arange(3000)
    cell = innertop.Cell(ids, ids, np.ones(3000, bool), x)
    q, need = x[:40], np.sort(x[:40] @ x.T, axis=1)[:, -11]
    query, row, score = cell.search(ids[:40], q, need, 10)
    assert (np.bincount(query, minlength=40) == 10).all()
    for i in range(40):
        want = sorted(((-s, j) for j, s in enumerate((x @ q[i]).tolist()) if j != i))[:10]
        assert [(-s, j) for s, j in zip(score[query == i], cell.vec_id[row[query == i]], strict=True)] == want
    pairs, _ = cell.buckets[0][1].by_coordinate(q / np.linalg.norm(q, axis=1, keepdims=True), np.full(40, 0.97))
    assert len(pairs) < 0.5 * 40 * innertop.BUCKET_ROWS
