"""What queries leave and hold on disk."""

from __future__ import annotations

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from memtide.llm import suffixdedup
from memtide.llm.scratch import materialize
from memtide.operators import gate, lists, postings, retrieval
from memtide.plans.lineage import cut


def shuffle_bytes(spark: SparkSession) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def settled_bytes(spark: SparkSession, least: int) -> int:
    """The same once files that are being deleted are gone."""
    for _ in range(50):
        if shuffle_bytes(spark) <= least:
            break
        time.sleep(0.1)
    return shuffle_bytes(spark)


def test_written_tables_leave_no_shuffle_files(spark) -> None:
    rows, before = spark.range(20_000).repartition(7), shuffle_bytes(spark)
    assert cut(rows).count() == materialize(rows, "rows").count() == 20_000
    assert settled_bytes(spark, before + 10_000) <= before + 10_000  # the counts' own


def test_repeats_are_removed_in_rounds_with_one_round_on_disk(spark, monkeypatch) -> None:
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 9))) for _ in range(3000)]
    shared = [" ".join(rnd.choices(words, k=40)) for _ in range(20)]
    texts = {i: " ".join([*rnd.choices(words, k=30), *rnd.sample(shared, 2), *rnd.choices(words, k=30)]) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    seen: dict[bytes, int] = {}
    for i, t in texts.items():
        for p in range(len(t) - 49):
            seen.setdefault(t[p : p + 50].encode(), i)
    want = {}
    for i, t in texts.items():
        gone = {q for p in range(len(t) - 49) if seen[t[p : p + 50].encode()] < i for q in range(p, p + 50)}
        want[i] = (len(gone), hashlib.sha256("".join(c for q, c in enumerate(t) if q not in gone).encode()).hexdigest())
    monkeypatch.setattr(suffixdedup, "ROUND_BYTES", 1)
    monkeypatch.setattr(suffixdedup, "ROUNDS", 2)
    made, before = [], shuffle_bytes(spark)
    monkeypatch.setattr(suffixdedup, "materialize", lambda df, tag: made.append((tag, settled_bytes(spark, before))) or materialize(df, tag))
    out = suffixdedup.remove_repeats(docs, block_bytes=4000)
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in out.collect()} == want
    assert [tag for tag, _ in made].count("reports") == suffixdedup.ROUNDS and all(n <= before for _, n in made)


def test_recall_holds_one_round_of_scores_on_disk(spark, monkeypatch) -> None:
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(40)], k=12)), [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    memories = spark.createDataFrame(rows, "pos bigint, text string, embedding array<double>").localCheckpoint()
    queries = memories.where("pos % 10 = 0").withColumnRenamed("pos", "query_id")
    found = lambda: sorted(map(tuple, retrieval.recall(queries, memories, None, retrieval.RecallConfig(candidates=10)).collect()))
    want, sizes = found(), []
    monkeypatch.setattr(lists, "PAIRS", 1)
    monkeypatch.setattr(lists, "ASKING", 6)  # of 30 queries
    before = shuffle_bytes(spark) + 10_000  # counts; all scores are ten times that
    monkeypatch.setattr(lists, "cut", lambda df: sizes.append(settled_bytes(spark, before)) or cut(df))
    assert found() == want
    assert len(sizes) == 2 + 5 and max(sizes) <= before


@pytest.mark.parametrize("told", [4_000_000, 60])
def test_weighted_search_shuffles_no_pairs(spark, monkeypatch, told: int) -> None:
    monkeypatch.setattr(postings, "MAX_TOLD", told)
    monkeypatch.setattr(postings, "BLOCK_ROWS", 32)
    monkeypatch.setattr(postings, "BATCH", 3)
    rnd = random.Random(8)
    vector = lambda i: None if i % 17 == 0 else [1.0, 2.0] if i % 23 == 0 else [rnd.gauss(0, 1) for _ in range(4)]
    rows = [(i, None if i % 13 == 0 else " ".join(rnd.choices([f"w{j}" for j in range(30)], k=8)), vector(i)) for i in range(130)]
    memories = spark.createDataFrame(rows, "pos bigint, text string, embedding array<double>").localCheckpoint()
    queries = memories.where("pos % 9 = 1 or pos in (13, 17, 23, 34)").withColumnRenamed("pos", "query_id")
    rankings = [retrieval.vector_scores(queries, memories), retrieval.bm25_scores(queries, memories)]
    values = lambda df: {(r["query_id"], r["pos"]): round(r["score"], 9) for r in df.collect()}
    out = retrieval.weighted_search(queries, memories, 0.7, 0.3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert values(out) == values(retrieval.weighted_fusion(rankings, [0.7, 0.3]))


def test_queries_of_the_best_documents_are_not_shuffled(spark, monkeypatch) -> None:
    monkeypatch.setattr(postings, "BLOCK_ROWS", 32)
    monkeypatch.setattr(postings, "MAX_TOLD", 150)
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices([f"w{j}" for j in range(50)], k=20)) + (" É漢🦊 x" if i % 3 else "")) for i in range(200)], "pos bigint, text string").localCheckpoint()
    queries = docs.where("pos % 9 = 0").withColumnRenamed("pos", "query_id")
    asked = postings.ask(queries, postings.build_index(docs))
    monkeypatch.setattr(postings, "_search", None)
    best = {(r["query_id"], r["rank"]): (r["pos"], r["n"]) for r in postings.top(asked, 5).collect()}
    every = postings.first(postings.scores(asked), 5)
    assert best == {(r["query_id"], r["rank"]): (r["pos"], r["n"]) for r in every.collect()} and len(best) == 5 * 23
    slow = postings.build_index(docs, tokenizer=lambda x: postings.tokenize(x))
    rows = lambda index: {(r["term"], tuple(sorted(zip(r["docs"], r["part"], strict=True)))) for r in index.lists.groupBy("term").agg(F.flatten(F.collect_list("docs")).alias("docs"), F.flatten(F.collect_list("part")).alias("part")).collect()}
    assert rows(postings.build_index(docs)) == rows(slow)


def test_contradictions_shuffle_no_pairs(spark, monkeypatch) -> None:
    rnd = random.Random(10)
    said = ["I use the red fox", "I do not use the red fox", "use the red fox", "not a red fox in use", "We never use red foxes"]
    texts = [*said, *(" ".join(rnd.choices(["red", "fox", "use", "not", "never", "the", "tea", "we"], k=6)) for _ in range(60)), said[1], said[0]]
    rows = spark.createDataFrame([(i % 60, t) for i, t in enumerate(texts)], "pos bigint, text string").localCheckpoint()  # a position may come twice
    a, b = rows.select(F.col("pos").alias("i"), F.col("text").alias("a")), rows.select(F.col("pos").alias("j"), F.col("text").alias("b"))
    want = sorted(map(tuple, a.join(b, F.col("i") < F.col("j")).select("i", "j", gate.contradiction_hint(F.col("a"), F.col("b")).alias("hint")).where("hint is not null").collect()))
    monkeypatch.setattr(gate, "MAX_TOLD", 40)
    out = gate.contradictions(rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == want and any(h.startswith("negation") for *_, h in want) and any(h.startswith("opp") for *_, h in want)


def test_scores_are_made_without_a_shuffle(spark, monkeypatch) -> None:
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(50)], "pos bigint, text string").localCheckpoint()
    indexes = []
    monkeypatch.setattr(postings, "build_index", lambda *x, f=postings.build_index: indexes.append(f(*x)) or indexes[-1])
    scores = retrieval.bm25_scores(docs.where("pos % 10 = 0").withColumnRenamed("pos", "query_id"), docs)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    assert scores.count() == 5 * 50  # though the lists are gone
    assert not Path(indexes[0].lists._memtide_cut.removeprefix("file://")).exists()
