from __future__ import annotations

from pathlib import Path

import pytest

from memtide.catalog import QUERIES
from memtide.operators import matrix, retrieval

DATA = Path("/root/testdata/sf0.001")


def test_more_queries_than_a_block_score_the_same(spark, monkeypatch) -> None:
    memories = spark.createDataFrame([(i, [float(i), 1.0, float(-i % 5)], f"w{i % 3} w{i % 5} x") for i in range(20)], "pos bigint, embedding array<double>, text string")
    queries = memories.selectExpr("pos as query_id", "embedding", "text")

    def scores() -> list[list[tuple]]:
        return [sorted((r["query_id"], r["pos"], round(r["score"], 9)) for r in f(queries, memories).collect()) for f in (retrieval.vector_scores, retrieval.bm25_scores)]

    whole = scores()
    monkeypatch.setattr(matrix, "MAX_CELLS", 12)
    assert scores() == whole and len(whole[0]) == 400


@pytest.mark.skipif(not DATA.is_dir(), reason="no driver tables")
def test_all_vectors_are_asked_and_searched(spark) -> None:
    out = QUERIES["vector_topk"](spark, str(DATA)).collect()
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    asked = {i for i in ids if i % 50 == 0}
    assert {r["query_id"] for r in out} == asked and len(out) == 10 * len(asked)
    docs = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r["pos"] for r in out} - docs
