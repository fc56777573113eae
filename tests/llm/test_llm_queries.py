from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from memtide.llm.scratch import materialize
from memtide.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_all_documents(spark, name: str) -> None:
    out = QUERIES[name](spark, str(DATA))
    n = out.count()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name.startswith(("op1_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_")):
        assert n == docs
    assert n > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name: str) -> None:
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=repr)
    assert rows(ours) == rows(theirs)


def test_stages(spark) -> None:
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, str(DATA)), "stage")
        assert out.columns == first.columns and 0 < out.count() <= docs.count()
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    packed = corpus_pipeline.pack_sequences(spark, docs, str(DATA))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(DATA)).count() == packed.count()


def test_near_copies_leave_one(spark) -> None:
    rows = [(i, "some text that is quite the same in all of them " * 4) for i in range(5)] + [(9, "a text of its own with other words inside it")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, rows[-1]]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, str(DATA)).collect()) == [0, 9]
