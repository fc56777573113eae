from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memtide.functions import hooks
from memtide.functions import text as T
from memtide.functions.lifecycle import becomes_stale, lifecycle_score, recency, touch, with_lifecycle
from memtide.functions.redact import redact, redact_messages
from memtide.functions.rules import load_packs, registry
from memtide.functions.vec import cosine, normalize
from memtide.operators.filtering import FilterConfig, decide, valid_importance
from memtide.operators.gate import contradiction_hint, contradictions, duplicate_gate


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "source", "store", "reason"), [
    ("", "hook", False, "empty"), ("ok", "hook", False, "too_short"), ("继续", "hook", False, "too_short"), ("可以。OK。接下来我们讨论一下架构设计。", "hook", True, "passed"),
    ("可以。好的。谢谢。再见。", "hook", False, "mostly_small_talk"), ("哈哈哈哈哈哈哈哈哈哈", "hook", False, "low_density"), ("ok", "mcp", True, "passed"), ("12345 67890", "mcp", False, "pure_digits"),
])
def test_filter(spark, text, source, store, reason) -> None:
    row = decide(spark.createDataFrame([(text,)], "text string"), source=source).first()
    assert (row["store"], row["reason"]) == (store, reason)


def test_filter_switches(spark) -> None:
    df = spark.createDataFrame([("",)], "text string")
    assert decide(df, force=True).first()["reason"] == "forced"
    assert decide(df, config=FilterConfig(enabled=False)).first()["score"] == 0.5
    assert decide(spark.createDataFrame([(None,)], "text string"), source="hook").first()["reason"] == "empty"


@pytest.mark.parametrize("text", ["sk-abcdefghij0123456789", "API_KEY = 'abcdef0123456789abcd'", "ghp_abcdefghijklmnopqrstuvwxyz0123456789", "eyJhbGciOi.eyJzdWIi.c2ln", "Authorization: Bearer abc.def", "password: hunter22", "https://me:pw@host.example", "DB_TOKEN=abcd1234efgh"])
def test_redact(spark, text: str) -> None:
    assert "[REDACTED]" in one(spark, redact(F.col("t")), t=text)


def test_redact_leaves_plain_text(spark) -> None:
    assert one(spark, redact(F.col("t")), t="I decided to use Python for the backend.") == "I decided to use Python for the backend."
    assert one(spark, redact(F.col("t"), []), t="password: hunter22") == "password: hunter22"
    m = spark.sql("select array(named_struct('role', 'user', 'content', 'password: hunter22')) as m")
    assert m.select(redact_messages(F.col("m")).alias("m")).first()["m"][0]["content"] == "[REDACTED]"


def test_text_functions(spark) -> None:
    assert one(spark, T.tokenize(F.col("t")), t="élan Ab-1") == ["é", "lan", "ab", "1"]
    assert one(spark, T.sentences(F.col("t")), t="One. Two? 三。四！ v1.2 x") == ["One.", "Two?", "三。", "四！", "v1.2 x"]
    assert one(spark, T.shannon_entropy(F.col("t")), t="aabb") == 1.0
    assert one(spark, T.repetition_ratio(F.col("t")), t="aabb") == pytest.approx(2 / 3)
    assert one(spark, T.detect_scripts(F.col("t")), t="12 34") == ["Unknown"]
    assert sorted(one(spark, T.detect_scripts(F.col("t")), t="abc漢字漢")) == ["CJK", "Latin"]
    assert one(spark, T.clean_small_talk(F.col("t")), t="Thanks. The port is 8080.") == "The port is 8080."
    assert [len(c) for c in one(spark, T.chunks(F.col("t"), 4), t="abcdefghij")] == [4, 4, 2]


def test_vectors(spark) -> None:
    f = lambda zero: one(spark, cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), zero))
    assert math.isnan(f("nan")) and f("zero") == 0 and f("eps") == 0
    assert one(spark, normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])


def test_lifecycle(spark) -> None:
    now = F.expr("timestamp_ntz'2024-03-01'")
    df = spark.createDataFrame([(datetime(2024, 1, 31), 1.0, 0)], "at timestamp_ntz, imp double, n bigint")
    assert df.select(recency(F.col("at"), now)).first()[0] == pytest.approx(0.5)
    score = lambda stale: df.select(lifecycle_score(F.col("at"), F.col("imp"), F.col("n"), F.lit(stale), now)).first()[0]
    assert score(False) == pytest.approx(1.5) and score(True) == pytest.approx(0.3)
    assert df.select(becomes_stale(F.col("at"), F.lit(0.5), F.col("n"), F.lit(False), F.expr("timestamp_ntz'2024-06-01'"))).first()[0]
    m = with_lifecycle(df.select(F.lit(1).alias("pos"), F.lit("x").alias("text"), F.col("at").alias("created_at"), F.lit(None).cast("struct<importance:double,access_count:bigint,last_accessed_at:timestamp_ntz,created_at:timestamp_ntz,content_hash:string,stale:boolean>").alias("lifecycle")))
    assert touch(m, m.select("pos"), now).first()["lifecycle"]["access_count"] == 1


def test_gate(spark) -> None:
    schema = "pos bigint, text string, embedding array<double>"
    old = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 0.0])], schema)
    new = spark.createDataFrame([(5, "x", [2.0, 0.1]), (6, "y", [0.7, 0.7]), (7, "z", [0.0, 0.0])], schema)
    assert {r["text"]: (r["ok"], r["similar_memory"]) for r in duplicate_gate(new, old).collect()} == {"x": (False, "a"), "y": (True, None), "z": (True, None)}


def test_contradictions(spark) -> None:
    rows = [(0, "I use Python"), (1, "I don't use Python"), (2, "The backend is running on port 8080"), (3, "The backend is not running on port 8080"), (4, "tea"), (5, None)]
    df = spark.createDataFrame(rows, "pos bigint, text string")
    pairs = {(r["i"], r["j"]): r["hint"] for r in contradictions(df).collect()}
    assert set(pairs) == {(0, 1), (2, 3)} and pairs[0, 1].startswith("negation")
    every = df.alias("a").crossJoin(df.alias("b")).where("a.pos < b.pos").where(contradiction_hint(F.col("a.text"), F.col("b.text")).isNotNull())
    assert every.count() == 2


def test_summarize(spark) -> None:
    f = lambda text, role="assistant": one(spark, hooks.summarize(F.col("t"), F.col("r")), t=text, r=role)
    assert f("First one. Second one.") == "First one."
    assert f("  x  ", "user") == "x"
    assert f("a\n\nb. c") == "a"
    long = "word " * 60
    assert f(long).endswith("…") and len(f(long)) <= 151


def test_exchange_and_lines(spark) -> None:
    m = spark.sql("select array(named_struct('role','user','content','q'), named_struct('role','tool','content','t'), named_struct('role','assistant','content','a')) as m")
    assert [r["content"] for r in m.select(hooks.last_exchange(F.col("m")).alias("x")).first()["x"]] == ["a"]
    assert len(m.select(hooks.with_last_assistant(F.col("m"), F.lit("new")).alias("x")).first()["x"]) == 4
    assert len(m.select(hooks.with_last_assistant(F.col("m"), F.lit("a")).alias("x")).first()["x"]) == 3
    assert one(spark, hooks.recall_lines(F.array(F.lit("a\nb")))).endswith("1. a b")
    assert one(spark, hooks.context_memory(F.lit("A.md"), F.lit(" x "))) == "[Project Context from A.md]\nx"


def test_importance_validation(spark) -> None:
    df = spark.createDataFrame([(1.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert df.where(valid_importance(F.col("v"))).count() == 1


def test_rule_packs(tmp_path) -> None:
    (tmp_path / "latin.json").write_text('{"scripts": ["Latin"], "small_talk": {"exact": ["Howdy"]}}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "metadata.json").write_text("{}")
    assert set(load_packs(tmp_path)) == {"Latin"}
    assert registry(tmp_path)[0].small_talk == ("howdy",)
