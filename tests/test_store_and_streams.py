from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from memtide.engine import MemoryEngine
from memtide.functions import lifecycle
from memtide.operators import markov
from memtide.sources import embedding, readers, schemas, store
from memtide.streaming import backlog, jobs, ordered


def test_engine_round_trip(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    texts = ["We decided to use Spark for the backend", "The port of the service is 8080", "My password: hunter2hunter", "x", ""]
    items = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    assert engine.store(items, datetime(2024, 1, 1)) == 3
    assert engine.store(items, datetime(2024, 1, 2)) == 0
    assert any("[REDACTED]" in r["text"] for r in engine.tables.read("memories").collect())
    found = engine.recall(["We decided to use Spark for the backend"], now=datetime(2024, 1, 2)).orderBy("rank").collect()
    assert found[0]["text"].startswith("We decided")
    engine.checkpoint("one")
    assert engine.consolidate().first()["updated"] == 3 and engine.status()["step"] == 1
    engine.touch(engine.tables.read("memories").select("pos"))
    assert {r["lifecycle"]["access_count"] for r in engine.tables.read("memories").collect()} == {1}
    engine.forget()
    assert engine.status()["memory_count"] == 0
    engine.restore("one")
    assert engine.status() == {"workspace": f"file://{tmp_path}/ws", "memory_count": 3, "prototypes": 4, "capacity_usage": 1.0, "prototype_capacity": 4, "skills": 0, "step": 0, "checkpoints": ["one"], "load_errors": []}
    assert engine.listing().first()["memory_count"] == 3
    with pytest.raises(FileNotFoundError):
        engine.restore("two")
    for bad in ("", "../x", "a b"):
        with pytest.raises(ValueError):
            engine.checkpoint(bad)
    with pytest.raises(ValueError):
        store.sandboxed("/r", "../x")


def test_positions_stay_unique_over_stores(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    told = ["We decided to use Spark for the backend", "The port of the service is 8080", "The team prefers small commits", "Backups run every night at two"]
    for day, text in enumerate(told):
        assert engine.store(spark.createDataFrame([(0, text)], "pos bigint, text string"), datetime(2024, 1, 1 + day)) == 1
    rows = engine.tables.read("memories").orderBy("pos").collect()
    assert [(r["pos"], r["text"]) for r in rows] == list(enumerate(told))
    found = engine.recall([told[2]], now=datetime(2024, 1, 9)).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len({r["text"] for r in found}) == len(found) and found[0]["text"] == told[2]
    engine.touch(spark.createDataFrame([(1,)], "pos bigint"))
    assert [r["lifecycle"]["access_count"] for r in engine.tables.read("memories").orderBy("pos").collect()] == [0, 1, 0, 0]


def test_touches_are_appended(spark, tmp_path) -> None:
    """Bytes written go by the ids, memories' files stay as they are, and parts are folded when there are many."""
    tables = store.Store(spark, f"file://{tmp_path}/ws")
    tables.touch(spark.range(3).withColumnRenamed("id", "pos"), F.expr("timestamp_ntz'2024-01-01'"))  # before there is any memory
    at = F.expr("timestamp_ntz'2024-01-01'")
    rows = spark.range(2000).select(F.col("id").alias("pos"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"), F.lit(None).cast("array<double>").alias("embedding"), at.alias("created_at"), F.lit(None).cast(schemas.MESSAGE).alias("source"), F.lit(None).cast(schemas.LIFECYCLE).alias("lifecycle"), F.lit(None).cast("map<string,string>").alias("metadata"))
    tables.write("memories", lifecycle.with_lifecycle(rows))
    counts = lambda: {r["pos"]: (r["n"], r["day"]) for r in tables.read("memories").select("pos", F.col("lifecycle.access_count").alias("n"), F.dayofmonth("lifecycle.last_accessed_at").alias("day")).collect() if r["n"]}
    assert counts() == {}
    versions = lambda: sorted(p.name for p in (tmp_path / "ws" / "memories").iterdir())
    before, want = versions(), {}
    for day in (9, 3, 5):
        tables.touch(spark.createDataFrame([(day % 3,), (7,), (7,), (None,), (5000,)], "pos bigint"), F.expr(f"timestamp_ntz'2024-01-0{day}'"))
        for pos in {day % 3, 7}:
            want[pos] = (want.get(pos, (0, 0))[0] + 1, day)
    assert counts() == want and versions() == before
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / "ws" / folder).rglob("*.parquet"))
    assert size("accesses") < size("memories") / 10
    tables.checkpoint("three")
    tables.MAX_PARTS = 3
    tables.touch(spark.createDataFrame([(7,)], "pos bigint"), F.expr("timestamp_ntz'2024-01-06'"))
    assert counts() == want | {7: (4, 6)} and len(versions()) == len(before) + 1 and tables.read("accesses").count() == 1
    tables.restore("three")
    assert counts() == want
    tables.forget()
    assert counts() == {} and tables.read("accesses").isEmpty()


def test_a_touch_and_a_merge_at_once_both_count(spark, tmp_path) -> None:
    one, other = (store.Store(spark, f"file://{tmp_path}/ws") for _ in range(2))
    life = "named_struct('importance', 1d, 'access_count', 0L, 'last_accessed_at', cast(null as timestamp_ntz), 'created_at', timestamp_ntz'2024-01-01', 'content_hash', '', 'stale', false)"
    row = lambda pos: spark.sql(f"select {pos}L as pos, 'm{pos}' as text, cast(null as array<double>) as embedding, timestamp_ntz'2024-01-01' as created_at, cast(null as {schemas.MESSAGE}) as source, {life} as lifecycle, cast(null as map<string,string>) as metadata")
    one.merge(row(0))
    tried = []

    def make(read):
        tried.append(1)
        if len(tried) == 1:
            other.touch(spark.createDataFrame([(0,)], "pos bigint"), F.expr("timestamp_ntz'2024-01-02'"))
        return {"memories": store.merged(read("memories"), row(1))}

    one.commit(make)
    assert len(tried) == 2  # made anew over what the other writer touched
    assert [(r["text"], r["lifecycle"]["access_count"]) for r in one.read("memories").orderBy("pos").collect()] == [("m0", 1), ("m1", 0)]


def test_processed_items_are_learned(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4, prediction=markov.FirstOrder(4))
    items = spark.createDataFrame([(0, "We decided to use Spark for the backend"), (1, "The port of the service is 8080"), (2, "")], "pos bigint, text string")
    assert engine.process(items, datetime(2024, 1, 1)) == 2
    assert engine.process(items, datetime(2024, 1, 1)) == 0  # a batch that comes again
    status = engine.status()
    assert (status["memory_count"], status["step"], status["prototypes"]) == (2, 1, 4) and status["capacity_usage"] == 1.0
    assert engine.tables.read("transitions").agg(F.sum("cnt")).first()[0] == 1
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(5, "A third memory that is of another kind")], "pos bigint, text string").write.json(f"{tmp_path}/in/a")
    stream = spark.readStream.schema("pos bigint, text string").json(f"{tmp_path}/in/*")
    engine.store_queue(stream).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert engine.status()["memory_count"] == 3 and engine.status()["step"] == 2


def test_items_stored_one_by_one_are_learned_as_a_chain(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4, prediction=markov.FirstOrder(4))
    heard = []
    engine.subscribe(heard.append)
    start = [np.array(r["vec"]) for r in engine.tables.read("prototypes").orderBy("proto_id").collect()]
    assert len(start) == 4 and all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in start)
    texts = ["We decided to use Spark for the backend", "The port of the service is 8080", "The team prefers small commits", "Backups run every night at two"]
    table, counts, chain = np.array(start), [0] * 4, []
    for day, text in enumerate(texts):
        assert engine.process(spark.createDataFrame([(0, text)], "pos bigint, text string"), datetime(2024, 1, 1 + day)) == 1
        x = embedding.HashEngine().encode([text])[0]
        near = int(np.argmax(table / np.linalg.norm(table, axis=1, keepdims=True) @ x))
        y = table[near] @ x
        moved = table[near] + 0.1 / (1 + 0.01 * counts[near]) * y * (x - y * table[near])
        table[near] = moved / np.linalg.norm(moved)
        table, counts[near] = table * 0.995, counts[near] + 1
        chain.append(near)
    rows = engine.tables.read("prototypes").orderBy("proto_id").collect()
    assert np.allclose([r["vec"] for r in rows], table) and [r["access_count"] for r in rows] == counts
    edges = {(r["prev"], r["next"]): r["cnt"] for r in engine.tables.read("transitions").collect()}
    assert sum(edges.values()) == 3 and edges == {(str(a), str(b)): list(zip(chain, chain[1:], strict=False)).count((a, b)) for a, b in zip(chain, chain[1:], strict=False)}
    learned = [e["report"] for e in heard if e["type"] == "learn"]
    assert [r["updated_ids"] for r in learned] == [[c] for c in chain] and [r["step"] for r in learned] == [0, 1, 2, 3] and all(r["unique_updated"] == 1 for r in learned)
    left = sum(n for (a, _), n in edges.items() if a == str(chain[-1]))
    again = edges.get((str(chain[-1]),) * 2, 0)
    assert learned[-1]["surprise_score"] == (1 - (again + 1) / (left + 4) if left else 1.0)
    assert engine.predict_next(chain[0]) is not None and {e["type"] for e in heard} == {"encode", "learn"}
    engine.unsubscribe(heard.append)
    engine.forget()
    assert engine.predict_next() is None and engine.status()["step"] == 0 and np.allclose([r["vec"] for r in engine.tables.read("prototypes").orderBy("proto_id").collect()], start)


def test_a_crash_while_learning_leaves_nothing_half_done(spark, tmp_path, monkeypatch) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4, prediction=markov.FirstOrder(4), learn_on_observe=True)
    items = spark.createDataFrame([(0, "We decided to use Spark for the backend")], "pos bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(engine.prediction, "update", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.process(items, datetime(2024, 1, 1))
    assert (engine.status()["memory_count"], engine.status()["step"]) == (0, 0)
    assert engine.process(items, datetime(2024, 1, 1)) == 1 and (engine.status()["memory_count"], engine.status()["step"]) == (1, 1)
    assert engine.store(spark.createDataFrame([(0, "The port of the service is 8080")], "pos bigint, text string")) == 1 and engine.status()["step"] == 2
    plain = engine.recall(["Spark backend"], use_bm25=False, use_lifecycle=False).orderBy("rank").collect()
    assert len(plain) == 2 and {round(r["score"], 6) for r in plain} == {0.0, 1.0}


def test_hook_handlers(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    assert engine.on_session_start() == {"memory_count": 0, "capacity_usage": 1.0}
    told = "We decided to always use the Spark engine for the important backend jobs"
    stop = [{"messages": [{"role": "user", "content": "old"}, {"role": "user", "content": told}, {"role": "assistant", "content": "ok"}], "last_assistant_message": "The goal is confirmed: password=hunter2hunter must never be logged"}, {"last_assistant_message": ""}, {}]
    payloads = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(stop)], "event_id bigint, payload string")
    assert engine.on_stop(payloads, datetime(2024, 1, 1)) == 2
    texts = [r["text"] for r in engine.tables.read("memories").orderBy("pos").collect()]
    assert texts[0] == told and "[REDACTED]" in texts[1] and "hunter2" not in texts[1]
    assert engine.on_stop(payloads, datetime(2024, 1, 1)) <= 1 and engine.status()["checkpoints"] == ["session"]  # what was learned meanwhile may move a vector
    asked = spark.createDataFrame([(1, json.dumps({"prompt": told})), (2, "{}")], "event_id bigint, payload string")
    got = {r["event_id"]: r["block"] for r in engine.on_prompt(asked, cutoff=0.0, now=datetime(2024, 1, 2)).collect()}
    assert got[1].startswith(f"Relevant memories:\n1. {told}") and got[2] == ""
    assert engine.on_session_start()["memory_count"] >= 2


def test_manifests_outlive_crashes_and_other_writers(spark, tmp_path) -> None:
    root = f"{tmp_path}/ws"
    one, two = store.Store(spark, f"file://{root}"), store.Store(spark, f"file://{root}")
    row = lambda i, t: spark.createDataFrame([(i, t)], "pos bigint, text string").selectExpr("pos", "text", "array(1.0d) as embedding", "timestamp_ntz'2024-01-01 00:00:00' as created_at", f"cast(null as {schemas.MESSAGE}) as source", f"cast(null as {schemas.LIFECYCLE}) as lifecycle", "cast(null as map<string,string>) as metadata")
    one.merge(row(0, "a"))
    (tmp_path / "ws/_manifests/current/000000000009").write_text('{"memories": "brok')  # a writer died half-way
    assert [r["text"] for r in two.read("memories").collect()] == ["a"]
    two.merge(row(0, "b"))
    assert sorted((r["pos"], r["text"]) for r in one.read("memories").collect()) == [(0, "a"), (1, "b")]
    number, pointers = one._latest("current")
    assert one._point("current", pointers, number) and not two._point("current", pointers, number)
    made = []

    def late(now: dict) -> object:
        if not made:
            made.append(1)
            two.merge(row(0, "c"))  # another writer is first
        return store.merge_memories(one._read("memories", now), row(0, "d"))

    one._change("memories", late)
    assert sorted((r["pos"], r["text"]) for r in one.read("memories").collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    version = one._pointers("current")["memories"]
    for file in (tmp_path / "ws/memories" / version).glob("*.parquet"):
        file.write_bytes(b"not parquet")
    errors = two.recover()
    assert set(errors) == {"memories"} and one.read("memories").count() == 0
    with pytest.raises(KeyError):
        store.update_skills(one.read("skills"), spark.createDataFrame([["no"] + [None] * 13], schemas.SKILL))


def test_http_engine(monkeypatch) -> None:
    import io
    import urllib.error
    import urllib.request

    asked = []

    def answer(request, timeout):
        texts = json.loads(request.data)["input"]
        asked.append((len(texts), request.headers.get("Authorization")))
        if any(len(t) > 200 for t in texts):
            raise urllib.error.HTTPError("u", 400, "bad", {}, io.BytesIO(b'{"error": "input exceeds the maximum context length"}'))
        return io.BytesIO(json.dumps({"data": [{"embedding": [float(len(t)), 1.0]} for t in texts]}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    monkeypatch.setenv("DEEPSEEK_API_KEY", "k")
    engine = embedding.create_engine("deepseek", url="http://x", batch=3)
    assert engine.encode(["a", "bb", "ccc", "dddd"]).tolist() == [[1, 1], [2, 1], [3, 1], [4, 1]]
    assert asked == [(3, "Bearer k"), (1, "Bearer k")]
    assert engine.encode(["x" * 400, "y"]).tolist() == [[200, 1], [1, 1]]
    assert embedding.create_engine("llama-server", url="http://x").encode([]).shape == (0, 0)

    def refused(request, timeout):
        raise urllib.error.HTTPError("u", 401, "no", {}, io.BytesIO(b"key"))

    monkeypatch.setattr(urllib.request, "urlopen", refused)
    with pytest.raises(urllib.error.HTTPError):
        engine.encode(["a" * 300])


def test_readers(spark, tmp_path) -> None:
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}}), "{bad", "", json.dumps({"type": "message", "role": "system", "content": [{"type": "input_text", "text": "no"}]}), json.dumps({"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "image"}, {"type": "output_text", "text": "b"}]})]))
    assert [(r["role"], r["content"]) for r in readers.transcript(spark, str(tmp_path / "t.jsonl")).collect()] == [("user", "hi"), ("assistant", "a\nb")]
    folder = tmp_path / "ctx"
    folder.mkdir()
    (folder / "claude.md").write_text("c")
    (folder / "AGENTS.md").write_text("a")
    (folder / "other.md").write_text("o")
    (folder / ".claude.md").write_bytes(b"\xff\xfe")
    assert [r["content"] for r in readers.context_files(spark, str(folder)).collect()] == ["a", "c"]
    (tmp_path / "s.jsonl").write_text('{"id": "a", "deprecated": false}\nnot json\n\n{"id": "b", "deprecated": true}\n')
    assert readers.skills_jsonl(spark, str(tmp_path / "s.jsonl")).count() == 2
    assert readers.skills_jsonl(spark, str(tmp_path / "s.jsonl"), active_only=True).count() == 1
    (tmp_path / "l.json").write_text(json.dumps([{"question_id": "q", "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "x"}], [{"role": "user", "content": "y"}, {"role": "assistant", "content": "z"}]]}]))
    assert [r["session_id"] for r in readers.haystack_turns(readers.longmemeval(spark, str(tmp_path / "l.json"))).orderBy("session_id").collect()] == ["s1", "s2", "s2"]
    (tmp_path / "m.json").write_text('[{"text": "a", "created_at": "2024-01-01T00:00:00"}, {"created_at": "2024-01-01T00:00:00"}]')
    assert readers.memories_json(spark, str(tmp_path / "m.json")).count() == 1
    assert readers.theme_corpus(spark).groupBy("theme").count().where("count = 5").count() == 3


def test_embedding(spark) -> None:
    with pytest.raises(ValueError):
        embedding.create_engine("nope")
    vec = embedding.create_engine("hash", dim=8).encode(["a", "a", "b"])
    assert vec.shape == (3, 8) and (vec[0] == vec[1]).all()

    def only_short(t: str) -> np.ndarray:
        if len(t) > 100:
            raise ValueError("too large")
        return np.array([float(len(t))])

    assert embedding.halving(only_short, "x" * 200)[0] == 100
    docs = spark.createDataFrame([(1, "x" * 5000)], "id bigint, text string")
    assert len(embedding.embed_chunked(docs, embedding.HashEngine).first()["embedding"]) == 64


def test_skill_upsert(spark) -> None:
    old = spark.createDataFrame([("a", 1, "t0", False), ("b", 1, "t0", False)], "id string, n int, created_at string, deprecated boolean")
    new = spark.createDataFrame([("a", 2, "t1", False)], old.schema)
    got = {r["id"]: (r["n"], r["created_at"]) for r in store.upsert_skills(old, new).collect()}
    assert got == {"a": (2, "t0"), "b": (1, "t0")}


def test_backlog_refuses_flushes_stops_and_goes_on(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    queue = backlog.Backlog(engine, f"file://{tmp_path}/q", max_pending=3)
    queue.put(["We decided to use Spark for the backend", ("The port of the service is 8080", 2.0)])
    with pytest.raises(backlog.Full):
        queue.put(["one", "two"])
    assert queue.pending() == 2 and not queue.alive() and not queue.flush(0.1)
    queue.start()
    assert queue.alive() and queue.flush() and queue.pending() == 0 and queue.stop(60) and not queue.alive()
    assert engine.status()["memory_count"] == 2
    queue.put(["The team prefers small commits"])
    again = backlog.Backlog(engine, f"file://{tmp_path}/q", max_pending=3)
    assert again.pending() == 1
    again.start()
    assert again.flush() and again.stop(60) and engine.status()["memory_count"] == 3 and again.pending() == 0
    step = engine.status()["step"]
    again._batch(spark.createDataFrame([(2, "The team prefers small commits", 1.0)], backlog.ITEM), 1)  # comes again
    assert again.pending() == 0 and engine.status()["memory_count"] == 3 and engine.status()["step"] == step


def test_a_learned_batch_is_not_learned_again(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    rows = spark.createDataFrame([(i, [float(i == d) for d in range(64)]) for i in range(3)], "id bigint, embedding array<double>")
    assert engine.learn(rows, batch=0).first()["updated"] == 3 and engine.learn(rows, batch=0) is None
    other = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    assert other.learn(rows, batch=0) is None and other.learn(rows, batch=1).first()["step"] == 1 and other.status()["step"] == 2


def test_stop_reads_the_transcript_when_there_are_no_messages(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws", embedding.HashEngine, n_prototypes=4)
    told = "We decided to always use the Spark engine for the important backend jobs"
    line = {"type": "message", "role": "user", "content": [{"type": "input_text", "text": told}]}
    (tmp_path / "t.jsonl").write_text("broken\n" + json.dumps(line) + "\n")
    payloads = spark.createDataFrame([(0, json.dumps({"transcript_path": str(tmp_path / "t.jsonl")})), (1, json.dumps({"messages": [], "transcript_path": str(tmp_path / "none.jsonl")}))], "event_id bigint, payload string")
    assert engine.on_stop(payloads, datetime(2024, 1, 1)) == 1
    assert [r["text"] for r in engine.tables.read("memories").collect()] == [told]


def test_streams_equal_batches(spark, tmp_path) -> None:
    rows = [(f"s{i % 3}", i, "abcab"[i * 7 % 5]) for i in range(60)]
    spark.createDataFrame(rows, "session string, step bigint, item string").repartition(3).write.parquet(str(tmp_path / "e"))
    stream = jobs.online_transitions(spark.readStream.schema("session string, step bigint, item string").parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("t_edges").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["prev"], r["next"]): r["n"] for r in spark.table("t_edges").groupBy("prev", "next").agg(F.count("*").alias("n")).collect()}
    assert got == {(r["prev"], r["next"]): r["cnt"] for r in markov.transitions(spark.read.parquet(str(tmp_path / "e"))).collect()}
    cmds = [("w", i, "Shell", f"adb -s DEV{i} shell reboot bootloader") for i in range(12)]
    spark.createDataFrame(cmds, "workspace string, event_id bigint, tool string, command string").coalesce(1).write.parquet(str(tmp_path / "k"))
    tracked = jobs.track(spark.readStream.schema("workspace string, event_id bigint, tool string, command string").parquet(str(tmp_path / "k")), window=50)
    tracked.writeStream.format("memory").queryName("t_track").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    seen = [(r["repeat_count"], r["ready"]) for r in spark.table("t_track").orderBy("event_id").collect()]
    assert any(ready for _, ready in seen) and seen[0] == (1, False)
    after = next(i for i, (_, ready) in enumerate(seen) if ready) + 1
    assert after == len(seen) or seen[after][0] == 1  # a ready cluster is forgotten


def test_skill_mining_stream(spark, tmp_path) -> None:
    rows = [(i, "w", "Shell", f"git log --grep DEV{i} --all --oneline --stat", i % 4 > 0) for i in range(12)]
    schema = "event_id bigint, workspace string, tool string, command string, ok boolean"
    tables = store.Store(spark, f"file://{tmp_path}/ws")
    for part in range(2):
        spark.createDataFrame(rows if part == 0 else [(100 + i, *r[1:]) for i, r in enumerate(rows)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    for part in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / str(part)))
        jobs.mine_skills(stream, tables).option("checkpointLocation", str(tmp_path / f"ck{part}")).trigger(availableNow=True).start().awaitTermination()
    found = tables.read("skills").collect()
    assert len(found) == 1 and found[0]["template"].startswith("git log --grep {")
    assert found[0]["usage_count"] == 9 and found[0]["failure_count"] == 3
    assert tables.read("events").count() == 0


def test_replace_learns_one_by_one(spark, tmp_path) -> None:
    engine = MemoryEngine(spark, f"file://{tmp_path}/ws2", embedding.HashEngine, n_prototypes=2)
    items = spark.createDataFrame([(0, "We use Spark for it"), (1, "The port is 8080 now")], "pos bigint, text string")
    assert engine.replace(items, datetime(2024, 1, 1)) == 2
    assert engine.tables.read("prototypes").agg(F.sum("access_count")).first()[0] == 2


def test_custom_scorer_and_block(spark) -> None:
    from memtide.functions.hooks import recall_block, tool_command
    from memtide.operators import retrieval

    m = spark.createDataFrame([(i, f"text {i}", [1.0, float(i)]) for i in range(3)], "pos bigint, text string, embedding array<double>")
    q = spark.createDataFrame([(0, "x", [1.0, 0.0])], "query_id bigint, text string, embedding array<double>")
    by_pos = lambda queries, memories: memories.select(F.lit(0).cast("bigint").alias("query_id"), "pos", F.col("pos").cast("double").alias("score"))
    out = retrieval.recall(q, m, F.lit(1.0), retrieval.RecallConfig(similarity=1.0), scorers=[by_pos]).join(m.select("pos", "text"), "pos")
    assert out.orderBy("rank").first()["pos"] == 2
    assert recall_block(out, 0.7).first()["block"].startswith("Relevant memories:\n1. text 2")
    row = spark.createDataFrame([("Read", '{"b": 1, "a": 2}')], "t string, i string")
    assert row.select(tool_command(F.col("t"), F.col("i"))).first()[0] == '{"a":2,"b":1}'


def test_rows_of_a_key_are_put_in_order_in_bounded_memory() -> None:
    n, alive = 5000, []
    told = [(i * 7919 % n // 2, i) for i in range(n)]

    real = ordered._written
    for runs in (64, 4):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ordered, "RUNS", runs)
            patch.setattr(ordered, "_written", lambda rows: alive.append(len(rows) if isinstance(rows, list) else 0) or real(rows))
            assert list(ordered.in_order(iter(told), held=300)) == sorted(told, key=lambda r: r[0])
    assert len(alive) > 30 and max(alive) <= 300


class _States(dict):
    """What a stateful processor asks of its states, and how often."""

    def __init__(self) -> None:
        super().__init__()
        self.asked, self.value = 0, None

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802
        self.asked += 1
        return dict.get(self, key)

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        self.asked += 1
        return key in self

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.asked += 1
        self[key] = value


def test_transitions_ask_the_state_once_an_edge() -> None:
    job = jobs.OnlineTransitions()
    job.last, job.counts = _States(), _States()
    made = lambda low, high: [r["cnt"] for r in job.handleInputRows(("s",), (Row(step=i, tie=0, item="ab"[i % 2]) for i in reversed(range(low, high))), None)]
    assert made(0, 1000) == [i // 2 + 1 for i in range(999)] and made(1000, 2000) == [i // 2 + 1 for i in range(999, 1999)]
    assert job.counts == {("a", "b"): (1000,), ("b", "a"): (999,)} and job.counts.asked <= 6


def test_a_bounded_merge_gathers_no_rows_in_one_task(spark, tmp_path) -> None:
    schema = "pos bigint, text string, created_at string"
    disk = spark.createDataFrame([(i, f"t{i}", "2024") for i in range(40)], schema)
    new = spark.createDataFrame([(i, f"t{i}", "2024") for i in range(30, 60)], schema)
    for most in (25, 60, 61):
        out = store.merged(disk, new, most)
        assert "Limit" not in out._jdf.queryExecution().toString() and "TakeOrdered" not in out._jdf.queryExecution().toString()
        assert sorted(r["pos"] for r in out.collect()) == list(range(max(0, 60 - most), 60))
    assert store.merged(disk, new, 0).count() == 0


def test_tracker_emits_in_parts() -> None:
    job, rows = jobs.Tracker(), [(i, "k", f"run {i}") for i in range(2 * jobs.EMITTED + 5)]
    kept = []
    job.state = type("S", (), {"get": lambda self: iter(()), "clear": lambda self: None, "put": lambda self, x: kept.extend(x)})()
    frames = (pd.DataFrame(rows[at : at + 3000], columns=["event_id", "cluster_key", "command"]) for at in range(len(rows) // 3000 * 3000, -1, -3000))
    sizes = [out["event_id"].tolist() for out in job.handleInputRows(("w",), frames, None)]
    assert max(map(len, sizes)) <= jobs.EMITTED and sum(sizes, []) == [i for i, *_ in rows] and kept[-1][0] == rows[-1][0]
