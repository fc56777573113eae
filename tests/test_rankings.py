"""Searches that leave rows out below a bound, against scoring and ranking every row."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memtide.operators import matrix, postings, retrieval


def texts(n: int, seed: int = 1) -> list[str | None]:
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weigh = [1 / (i + 1) for i in range(60)]
    out = [" ".join(rnd.choices(words, weigh, k=rnd.choice((0, 1, 5, 40, 200)))) for _ in range(n)]
    return [*out[: n - 4], None, "", out[3], out[3]]


def plain_bm25(queries: dict, docs: dict) -> dict:
    tokens = {p: Counter((t or "").split()) for p, t in docs.items()}
    n, average = len(docs), sum(c.total() for c in tokens.values()) / len(docs)
    df = Counter(t for c in tokens.values() for t in c)
    out = defaultdict(dict)
    for q, text in queries.items():
        for p, c in tokens.items():
            total = sum(round(k * max(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1), 0.25) * (c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / average))) * 1e9) for t, k in Counter((text or "").split()).items() if t in c)
            if total:
                out[q][p] = total / 1e9
    return out


def ranked(scores: dict) -> list:
    return sorted(scores, key=lambda p: (-round(scores[p], 9), p))


@pytest.fixture(scope="module")
def corpus(spark):
    docs = dict(enumerate(texts(150)))
    queries = {p: t for p, t in docs.items() if p % 12 == 0} | {900: None, 901: "nowhere", 902: docs[3] or "w1"}
    return spark.createDataFrame(list(queries.items()), "query_id bigint, text string"), spark.createDataFrame(list(docs.items()), "pos bigint, text string").repartition(3), plain_bm25(queries, docs)


@pytest.mark.parametrize(("block", "k"), [(4096, 7), (16, 7), (16, 1), (16, 500)])
def test_bm25_top_is_the_top_of_all_scores(corpus, monkeypatch, block: int, k: int) -> None:
    monkeypatch.setattr(postings, "BLOCK_ROWS", block)
    monkeypatch.setattr(postings, "GROUP_ROWS", 5)
    monkeypatch.setattr(postings, "SALT_BLOCKS", 3)
    queries, docs, want = corpus
    found = {(r["query_id"], r["rank"]): (r["pos"], r["score"]) for r in retrieval.bm25_top(queries, docs, k).collect()}
    assert found == {(q, i + 1): (p, s[p]) for q, s in want.items() for i, p in enumerate(ranked(s)[:k])}


def test_bm25_scores_are_those_of_all_pairs(corpus) -> None:
    queries, docs, want = corpus
    assert {(r["query_id"], r["pos"]): r["score"] for r in retrieval.bm25_scores(queries, docs).collect()} == {(q, p): x for q, s in want.items() for p, x in s.items()}
    assert retrieval.bm25_scores(queries, docs.limit(0)).count() == 0 and retrieval.bm25_top(queries.limit(0), docs, 3).count() == 0


@pytest.mark.parametrize("need", [0, 10**8, 10**9, 5 * 10**9, 10**11])
def test_a_block_scores_exactly_what_reaches_the_threshold(need: int) -> None:
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    lists = {t: np.sort(rnd.choice(400, rnd.integers(1, 300), replace=False)) for t in "abcdefgh"}
    part = {t: rnd.random(len(d)) for t, d in lists.items()}
    batch = pa.RecordBatch.from_pydict({"term": list(lists), "top": [part[t].max() for t in lists], "docs": [d.tolist() for d in lists.values()], "part": [p.tolist() for p in part.values()]})
    block = postings.Block([batch])
    weights = dict(zip("aceghz", (0.1, 2.0, 0.5, 3.0, 0.25, 9.0), strict=True))
    want = np.zeros(400)
    for t, w in weights.items():
        for d, x in zip(lists.get(t, ()), part.get(t, ()), strict=True):
            want[d] += np.rint(w * x * postings.UNIT)
    got = block.scores(list(weights), list(weights.values()), need)
    assert ((want[block.docs] == got) | ((want[block.docs] < need) & (got < need))).all()


@pytest.mark.parametrize("share", [0.0, 1 / 32, 0.4, 2.0])
def test_near_scores_are_settled_to_exact_ones(monkeypatch, share: float) -> None:
    """Ends, bounds and copies are those of exact sums, whether terms are columns of the matrix or not."""
    import pyarrow as pa

    monkeypatch.setattr(postings, "DENSE_SHARE", share)
    rnd = np.random.default_rng(3)
    names = [f"t{i}" for i in range(40)]
    rows = rnd.random((40, 300)) * (rnd.random((40, 300)) < rnd.random((40, 1)) ** 2)
    rows[:, 250:] = rows[:, :50]  # copies tie exactly
    rows[:, 7] = 0
    rows[0, 7], rows[1:, 8], rows[0, 8] = 1e-12, 0, 2e-9  # scores about a unit
    held = [np.flatnonzero(r) for r in rows]
    block = postings.Block([pa.RecordBatch.from_pydict({"term": names, "top": rows.max(axis=1), "docs": [h.tolist() for h in held], "part": [r[h].tolist() for r, h in zip(rows, held, strict=True)]})])
    queries = [{"terms": [*names[i::3], "absent"], "weights": [*(rnd.random(len(names[i::3])) * 5), 2.0]} for i in range(3)]
    for q, near in zip(queries, block.near(queries), strict=True):
        want = block.scores(q["terms"], q["weights"], 0)
        live = np.flatnonzero(want > 0)
        order = live[np.lexsort((block.docs[live], -want[live]))]
        assert (np.abs(near.total - want) <= near.margin).all() and ((near.total > 0) == (want > 0)).all()
        for need in (0, int(want[order[10]]), int(want[order[10]]) + 1):
            assert near.first(20, need).tolist() == [x for x in order if want[x] >= need][:20]
        assert near.last(30).tolist() == order[::-1][:30].tolist() and near.first(0).tolist() == near.last(0).tolist() == []
        told = np.r_[order[:20], order[-30:]]
        assert (near.total[told] == want[told]).all()


@pytest.mark.parametrize(("n", "k", "same"), [(150, 3, False), (150, 60, False), (40, 3, True), (150, 3, True)])
def test_ends_of_rankings_give_the_fusion_of_whole_ones(spark, monkeypatch, n: int, k: int, same: bool) -> None:
    monkeypatch.setattr(postings, "BLOCK_ROWS", 32)
    monkeypatch.setattr(matrix, "ROWS", 20)
    monkeypatch.setattr(retrieval, "LEAST_ENDS", 2)
    rnd = random.Random(4)
    docs = dict(enumerate(texts(n, seed=7)))
    if same:  # every text is ranked but one
        docs = {p: (t or "") + " w0" if p != 5 else "alone" for p, t in docs.items()}
    vectors = {p: [rnd.gauss(0, 1) for _ in range(3)] for p in docs}
    vectors[9] = vectors[8]
    asked = {q: (docs[q], vectors[q]) for q in range(0, n, 15)}
    scored, fused = plain_bm25({q: t for q, (t, _) in asked.items()}, docs), {}
    for q, (_, v) in asked.items():
        cosine = {p: float(np.round(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x), 9)) for p, x in vectors.items()}
        fused[q] = defaultdict(float)
        for scores in (cosine, scored.get(q, {})):
            for i, p in enumerate(ranked(scores)):
                fused[q][p] += 1 / (61 + i)
    queries = spark.createDataFrame([(q, t, v) for q, (t, v) in asked.items()], "query_id bigint, text string, embedding array<double>")
    memories = spark.createDataFrame([(p, t, vectors[p]) for p, t in docs.items()], "pos bigint, text string, embedding array<double>").repartition(3)
    index = postings.build_index(memories)
    rankings = [retrieval.VectorRanking(queries, memories), retrieval.TermRanking(postings.ask(queries, index))]
    got = defaultdict(dict)
    for r in retrieval.fused_ends(rankings, index.n, k).collect():
        assert abs(r["low"] - min(fused[r["query_id"]].values())) < 1e-15 and abs(r["high"] - max(fused[r["query_id"]].values())) < 1e-15
        got[r["query_id"]][r["pos"]] = r["score"]
    for q, want in fused.items():
        assert ranked(got[q])[:k] == ranked(want)[:k]
        assert all(abs(got[q][p] - want[p]) < 1e-15 for p in got[q])


def test_recall_of_rows_without_vectors_or_texts(spark) -> None:
    memories = spark.createDataFrame([(0, "red fox", [1.0, 0.0]), (1, None, [0.0, 1.0]), (2, "red", None), (3, "", None)], "pos bigint, text string, embedding array<double>")
    queries = spark.createDataFrame([(0, "red", [1.0, 0.0]), (1, "red", None), (2, None, [1.0, 0.0]), (3, None, None)], "query_id bigint, text string, embedding array<double>")
    out = retrieval.recall(queries, memories, F.lit(1.0), retrieval.RecallConfig(similarity=1.0)).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["pos"])
    assert found[0][0] == 0 and set(found[0]) == {0, 1, 2} and found[1] == [2, 0] and found[2] == [0, 1] and 3 not in found
    assert retrieval.recall(queries, memories.limit(0), F.lit(1.0)).count() == 0


def test_queries_are_not_written_once_a_block(corpus, monkeypatch) -> None:
    monkeypatch.setattr(postings, "BLOCK_ROWS", 16)
    monkeypatch.setattr(postings, "MAX_TOLD", 100)
    queries, docs, want = corpus
    scores = retrieval.bm25_scores(queries, docs)
    plan = scores._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan.split("== Physical Plan ==")[1].replace("LeftSemi", "").replace("BroadcastHashJoin", "")
    assert {(r["query_id"], r["pos"]): r["score"] for r in scores.collect()} == {(q, p): x for q, s in want.items() for p, x in s.items()}


@pytest.mark.parametrize(("cells", "told"), [(4_000_000, 4_000_000), (300, 200)])
def test_lists_are_fused_like_rows(spark, corpus, monkeypatch, cells: int, told: int) -> None:
    from memtide.operators import lists

    monkeypatch.setattr(lists, "CELLS", cells)
    monkeypatch.setattr(postings, "MAX_TOLD", told)
    monkeypatch.setattr(postings, "BLOCK_ROWS", 32)
    rnd = random.Random(3)
    vector = lambda i: None if i % 17 == 0 else [0.0] * 4 if i % 19 == 0 else [1.0, 2.0] if i % 23 == 0 else [rnd.choice((-1.0, 0.5, 1.0)) for _ in range(4)]
    rows = [(i, x, vector(i)) for i, x in enumerate(texts(150))]
    memories = spark.createDataFrame([*rows, (7, "w1 w2", [1.0, 1.0, 1.0, 1.0])], "pos bigint, text string, embedding array<double>").repartition(3)
    queries = memories.where("pos % 6 = 1 or pos in (34, 46)").dropDuplicates(["pos"]).withColumnRenamed("pos", "query_id").localCheckpoint()
    got = {(r["query_id"], r["pos"]): round(r["score"], 12) for r in retrieval.rank_fusion(queries, memories).collect()}
    rankings = [retrieval.vector_scores(queries, memories), retrieval.bm25_scores(queries, memories)]
    assert got == {(r["query_id"], r["pos"]): round(r["score"], 12) for r in retrieval.reciprocal_rank_fusion(rankings).collect()}
    monkeypatch.setattr(lists, "MOST", 10)
    assert got == {(r["query_id"], r["pos"]): round(r["score"], 12) for r in retrieval.rank_fusion(queries, memories).collect()}


def test_recall_by_lists_is_recall_by_ends(spark, monkeypatch) -> None:
    from memtide.operators import lists

    rnd = random.Random(5)
    memories = spark.createDataFrame([(i, x, [rnd.gauss(0, 1) for _ in range(4)]) for i, x in enumerate(texts(150))], "pos bigint, text string, embedding array<double>")
    queries = memories.where("pos % 40 = 0").withColumnRenamed("pos", "query_id")
    found = lambda: sorted(map(tuple, retrieval.recall(queries, memories, None, retrieval.RecallConfig(candidates=10)).collect()))
    ends = []
    monkeypatch.setattr(retrieval, "fused_ends", lambda *x, f=retrieval.fused_ends: ends.append(1) or f(*x))
    by_lists = found()
    assert by_lists and not ends  # no rounds of many jobs
    monkeypatch.setattr(lists, "MOST", 10)
    assert found() == by_lists and ends
