from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memtide.operators import gate, markov, metrics, prototypes, retrieval, skills

MEM = "pos bigint, text string, embedding array<double>"


def memories(spark):
    return spark.createDataFrame([(0, "Python programming language", [1.0, 0.0]), (1, "Java programming language", [0.0, 1.0]), (2, "Ruby gems and bundles", [-1.0, 0.0])], MEM)


def test_bm25(spark) -> None:
    q = spark.createDataFrame([(0, "Python programming", [1.0, 0.0]), (1, "xyz missing", [1.0, 0.0])], "query_id bigint, text string, embedding array<double>")
    rows = {(r["query_id"], r["pos"]): r["score"] for r in retrieval.bm25_scores(q, memories(spark)).collect()}
    assert set(rows) == {(0, 0), (0, 1)} and rows[0, 0] > rows[0, 1]
    assert {r["pos"]: r["score"] for r in retrieval.vector_scores(q, memories(spark)).where("query_id = 0").collect()} == {0: 1.0, 1: 0.0, 2: -1.0}
    assert retrieval.bm25_scores(q, memories(spark).limit(0)).count() == 0


def scores(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in values.items()], "query_id bigint, pos bigint, score double")


def test_fusion(spark) -> None:
    a, b = scores(spark, {0: 1.0, 1: 0.5, 2: 0.1}), scores(spark, {0: 0.8, 1: 0.2, 2: 0.9})
    fused = {r["pos"]: r["score"] for r in retrieval.reciprocal_rank_fusion([a, b]).collect()}
    assert max(fused, key=fused.get) == 0 and fused[0] == pytest.approx(1 / 61 + 1 / 62)
    w = retrieval.weighted_fusion([scores(spark, {0: 1.0, 1: 0.0}), scores(spark, {0: 0.0, 1: 1.0})], [0.5, 0.5])
    assert {r["score"] for r in w.collect()} == {0.5}
    with pytest.raises(ValueError):
        retrieval.weighted_fusion([a], [0.5, 0.5])
    flat = lambda v, how: [r["s"] for r in scores(spark, v).select(retrieval.min_max("score", flat=how).alias("s")).collect()]
    assert flat({0: 2.0, 1: 2.0}, "sign") == [1.0, 1.0] and flat({0: 0.0, 1: 0.0}, "sign") == [0.0, 0.0] and flat({0: 1.0, 1: 3.0}, "one") == [0.0, 1.0]


def test_semantic_dedup(spark) -> None:
    rows = [(0, 0, 0.7, [1.0, 0.0, 0.0, 0.0]), (0, 1, 0.65, [0.99, 0.14, 0.0, 0.0]), (0, 2, 0.5, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id bigint, pos bigint, score double, embedding array<double>")
    assert sorted(r["pos"] for r in retrieval.semantic_dedup(df, 0.9).collect()) == [0, 2]
    assert retrieval.semantic_dedup(df, 1.0).count() == 3


def test_combined(spark) -> None:
    f = lambda r, x, add: spark.range(1).select(retrieval.combined(F.lit(r), F.lit(x), retrieval.RecallConfig(additive=add))).first()[0]
    assert f(0.8, 1.0, False) == pytest.approx(1.04) and f(0.8, 0.0, False) == pytest.approx(0.8)
    assert f(0.8, 1.0, True) == pytest.approx(0.7 * 0.8 + 0.3)


def test_oja_learn_against_numpy(spark) -> None:
    rng = np.random.default_rng(1)
    x, p = rng.standard_normal((20, 6)), rng.standard_normal((4, 6))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    c = prototypes.LearningConfig()
    vectors = spark.createDataFrame([(i, v.tolist(), 1.0 + i % 2) for i, v in enumerate(x)], "id bigint, embedding array<double>, importance double")
    protos = spark.createDataFrame([(i, v.tolist(), 1.0, 0, -1, -1) for i, v in enumerate(p)], "proto_id int, vec array<double>, strength double, access_count bigint, created_step int, last_access_step int")
    own = [int(np.argmax((p @ v) / np.linalg.norm(v))) for v in x]
    new, n, s = p.copy(), [0] * 4, [1.0] * 4
    for i, k in enumerate(own):
        y = new[k] @ x[i]
        new[k] += (1.0 + i % 2) * c.base_rate / (1 + n[k] * c.rate_decay) * y * (x[i] - y * new[k])
        new[k] /= np.linalg.norm(new[k])
        s[k] = min(s[k] + 1 / (1 + 0.2 * n[k]), 5.0)
        n[k] += 1
    got = {r["proto_id"]: r for r in prototypes.learn(vectors, protos, 3).collect()}
    for k in range(4):
        assert got[k]["vec"] == pytest.approx((new[k] * c.decay).tolist())
        assert got[k]["access_count"] == n[k] and got[k]["strength"] == pytest.approx(s[k] * c.decay)
        assert got[k]["created_step"] == (3 if n[k] else -1)
    w = prototypes.activation_weights(vectors, protos, prototypes.LearningConfig(top_k=2))
    assert all(r["n"] == 2 and r["t"] == pytest.approx(1) for r in w.groupBy("id").agg(F.sum((F.col("weight") > 0).cast("int")).alias("n"), F.sum("weight").alias("t")).collect())
    assert metrics.forgetting_suite(protos).first()[0] == pytest.approx(0.995**100)
    assert metrics.convergence_suite(vectors, protos, 2, c).first()["after"] is not None


def test_markov(spark) -> None:
    e = spark.createDataFrame([("s", i, str(i % 3)) for i in range(6)], "session string, step bigint, item string")
    edges = markov.transitions(e)
    assert {r["prev"]: r["next"] for r in markov.predict_next(edges).collect()} == {"0": "1", "1": "2", "2": "0"}
    pairs = spark.createDataFrame([("0", "1"), ("0", "2"), ("9", "0"), (None, "0")], "prev string, next string")
    got = {(r["prev"], r["next"]): r["surprise"] for r in markov.surprise(edges, pairs, 4).collect()}
    assert got["0", "1"] == pytest.approx(0.5) and got["0", "2"] > 0.5 and got["9", "0"] == 1 and got[None, "0"] == 1


@pytest.mark.parametrize(("commands", "template"), [
    ([f"adb -s {d} shell reboot bootloader" for d in ("ABC123", "DEF456", "GHI789")], "adb -s {var} shell reboot bootloader"), (["ls"], "ls"), ([], ""), (["cp a b", "cp c d"], "cp {a}"), (["x 1 y 2", "x 3 y 4"], "x {var} y {var2}"),
])
def test_skeleton(commands, template) -> None:
    assert skills.skeleton(commands)[0] == template


def test_ready_and_skills(spark) -> None:
    rows = [(i, "Shell", f"adb -s DEV{i} shell reboot bootloader") for i in range(10)] + [(20 + i, "Shell", f"cd /path/{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "event_id bigint, tool string, command string").withColumn("cluster_key", skills.cluster_key(F.col("tool"), F.col("command")))
    ready = skills.ready_clusters(skills.skeletons(df))
    found = skills.extract_skills(ready, F.lit("2024-01-01"))
    row = found.first()
    assert found.count() == 1 and row["type"] == "workflow" and row["template"].startswith("adb -s {")
    hits = skills.match_templates(df, found.withColumn("position", F.lit(0)))
    assert hits.where("skill_id is not null").count() == 10
    chosen = skills.select_skills(found.withColumn("confidence", F.lit(0.9)))
    assert "`Shell:adb`" in skills.format_skills(chosen).first()[0]
    assert skills.format_skills(chosen.limit(0)).first()[0] == ""
    changed = skills.skeletons(df.withColumn("command", F.regexp_replace("command", "reboot", "halt")))
    assert skills.revise(found, changed).first()["id"].endswith("_v2")


def test_confidence_fold(spark) -> None:
    random.seed(2)
    outcomes = [random.random() < 0.6 for _ in range(30)]
    c, u, f, d = 0.8, 0, 0, False
    for ok in outcomes:
        c, u, f = (min(1, 0.9 * c + 0.1), u + 1, f) if ok else (max(0, 0.95 * c - 0.05), u, f + 1)
        d = d or f >= 5 or (u >= 5 and c < 0.5)
    got = skills.confidence_fold(spark.createDataFrame([("a", i, ok) for i, ok in enumerate(outcomes)], "skill_id string, event_id bigint, ok boolean")).first()
    assert (got["confidence"], got["usage_count"], got["failure_count"], got["deprecated"]) == (pytest.approx(c), u, f, d)


def test_grouped_metrics(spark) -> None:
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, False)], "question_type string, recall_hit boolean, qa_hit boolean")
    got = {(r["scope"], r["question_type"]): r["recall_at_k"] for r in metrics.grouped_metrics(df).collect()}
    assert got["overall", None] == 0.6667 and got["by_type", "a"] == 1.0
    g = spark.createDataFrame([("q", ["a", "b"])], "question_id string, session_ids array<string>")
    assert metrics.set_hits(g, g).first()["recall_hit"]


def test_rank_by_ranges(spark) -> None:
    df = spark.range(2000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("pos"), (F.col("id") * 7919 % 50).cast("double").alias("score"))
    ranks = lambda d: {(r["query_id"], r["pos"]): r["rank"] for r in d.collect()}
    assert ranks(retrieval.rank_by_ranges(df, 6)) == ranks(retrieval.rank(df))
    fused = lambda **k: {(r["query_id"], r["pos"]): r["score"] for r in retrieval.reciprocal_rank_fusion([df], **k).collect()}
    assert fused(partitions=4) == fused()


def test_many_templates_fit_as_their_patterns_do(spark) -> None:
    rnd = random.Random(3)
    word = lambda: rnd.choice(("run", "git", "{v}", "{path2}", "a.b*", "--k", "x\\E", "é"))
    told = [" ".join(word() for _ in range(rnd.randrange(0, 5))) for _ in range(300)]
    rows = [(f"s{i}", i, t if i % 3 else None, None if i % 3 else t, i % 11 == 0) for i, t in enumerate(told)] + [("none", 400, None, None, False)]
    templates = spark.createDataFrame(rows, "id string, position int, template string, expansion string, deprecated boolean").orderBy(F.desc("position"))
    said = [" \t".join(rnd.choice(("run", "git", "7", "a.b*", "--k", "x\\E", "é", "{v}", "\u00a0")) for _ in range(rnd.randrange(0, 6))) + " " * (i % 3) for i in range(200)] + [None]
    events = spark.createDataFrame(list(enumerate(said)), "event_id bigint, command string")
    compiled = spark.createDataFrame(rows, templates.schema).where("not deprecated").select("id", skills.template_regex(F.coalesce("template", "expansion")).alias("re")).collect()
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    patterns = [(r["id"], java.compile(r["re"])) for r in compiled if r["re"] is not None]
    want = {i: next((k for k, p in patterns if c is not None and p.matcher(c).find()), None) for i, c in enumerate(said)}
    got = {r["event_id"]: r["skill_id"] for r in skills.match_templates(events, templates).collect()}
    assert got == want and len({v for v in want.values()}) > 10
    many = spark.range(100_000).select(F.col("id").cast("string"), F.col("id").cast("int").alias("position"), F.concat(F.lit("run {x} job"), F.col("id")).alias("template"), F.lit(None).cast("string").alias("expansion"), F.lit(False).alias("deprecated"))
    asked = spark.range(1000).select(F.col("id").alias("event_id"), F.concat(F.lit("run it job"), F.col("id") * 90).alias("command"))
    assert skills.match_templates(asked, many).where("skill_id = event_id * 90").count() == 1000


def test_contradictions_in_groups_of_any_size(spark, monkeypatch) -> None:
    """Every pair that the hint names, however the rows are dealt; a position that comes twice is no pair with itself."""
    rnd = random.Random(4)
    pick = lambda: " ".join(rnd.choice("ab1 cd ef gh ij kl mn not never".split()) for _ in range(rnd.randrange(1, 9)))
    rows = [(i, pick()) for i in range(70)] + [(3, "ab1 cd ef"), (3, "ab1 cd not ef"), (90, "We ab1 cd"), (91, "do not ab1 cd"), (92, None), (93, "")]
    texts = spark.createDataFrame(rows, "pos bigint, text string")
    a, b = texts.toDF("i", "a"), texts.toDF("j", "b")
    want = a.crossJoin(b).where("i < j").select("i", "j", gate.contradiction_hint(F.col("a"), F.col("b")).alias("hint")).where("hint is not null")
    monkeypatch.setattr(gate, "NEGATED_ROWS", 9)
    monkeypatch.setattr(gate, "OTHER_ROWS", 5)
    assert sorted(map(tuple, gate.contradictions(texts).collect())) == sorted(map(tuple, want.collect()))
