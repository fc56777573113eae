"""Each operator against brute force, on rows that hold nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from memtide.llm import chatformat, components, decontam, linededup, packing, quality_bayes, quality_rules, secrets, simhash, suffixdedup, toxicity
from memtide.llm.queries import tokenizer_files

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, word string"


def odd_texts(n: int = 60, seed: int = 3) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    words = [a + b for a in ("the", "an", "ou", "re", "é", "st") for b in ("", "tion", "le", "ing", "ß")]
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [make(30) for _ in range(4)]
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        parts = [make(rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 5))]
        if rnd.random() < 0.5:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(shared))
        rows.append((i, "\n".join(parts)))
    base = rows[5][1]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, base), (104, base), (105, base.upper()), (106, base + " x"), (107, "one two"), (108, "one"), (109, "ab " * 20000), (110, "\n\n" + shared[0] + "\n" + shared[0] + "\n")]
    return rows


def frame(spark, rows):
    full = [(i, t, (None, "en", "de")[(i or 0) % 3], (None, "s0", "s0", "s1")[(i or 0) % 4], None, "fp", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# 1


def slow_print(text: str | None, k: int = 3) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def slow_components(nodes, linked) -> dict:
    label = {n: n for n in nodes}
    for _ in nodes:
        before = dict(label)
        for a in nodes:
            for b in nodes:
                if a < b and linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_simhash(spark, docs, none) -> None:
    prints = {i: slow_print(t) for i, t in odd_texts()}
    assert simhash.fingerprint(("word " * 70000).encode()) == slow_print("word " * 70000)
    want = slow_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(prints) and all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)
    twice = simhash.near_duplicates(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(got) and {(r["doc_id"], r["component_id"]) for r in twice} == {(r["doc_id"], r["component_id"]) for r in got}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a b c"), (3, "a b c")])).agg(F.min("component_id")).first()[0] == 3


def test_trie_walk_and_splitting(spark) -> None:
    rnd = random.Random(1)
    prints = {0, (1 << 64) - 1}
    while len(prints) < 400:
        x = rnd.getrandbits(64)
        prints |= {x, x ^ 1 << rnd.randrange(64), x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)}
        prints |= {7 << 60 | rnd.getrandbits(4)}  # a crowded node
    every = np.array(sorted(prints), np.uint64)
    p, q = map(np.concatenate, zip(*simhash.linked_pairs(every, every, [(64, 2)], limit=50), strict=True))
    near = {(i, j) for i in range(len(every)) for j in range(len(every)) if (int(every[i]) ^ int(every[j])).bit_count() <= 2}
    assert set(zip(p.tolist(), q.tolist(), strict=True)) == near
    p2, q2 = map(np.concatenate, zip(*simhash.linked_pairs(every, every, [(20, 1), (64, 9)]), strict=True))
    apart = lambda i, j: int(every[i]) ^ int(every[j])
    assert set(zip(p2.tolist(), q2.tolist(), strict=True)) == {(i, j) for i in range(len(every)) for j in range(len(every)) if apart(i, j).bit_count() <= 9 and (apart(i, j) >> 44).bit_count() <= 1}
    table = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp bigint")
    want = simhash.forest(np.arange(len(every)), p, q)
    for leaf, cap in ((1 << 16, 1 << 20), (8, 1 << 20), (8, 8), (64, 100)):  # small caps split nodes and groups again and again
        links = components.connected_components(simhash.trie_links(table, leaf=leaf, group_cap=cap))
        label = {r["node"]: r["label"] for r in links.collect()}
        signed = every.view(np.int64).tolist()
        groups = defaultdict(set)
        for x in signed:
            groups[label.get(x, x)].add(x)
        slow = defaultdict(set)
        for i, x in enumerate(signed):
            slow[want[i]].add(x)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in slow.values()}


def test_components(spark) -> None:
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 2


def test_chat_format(spark) -> None:
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\n", "a<", "<|turn|>x<|end|>", "<\\|end|>", "<<SYS>>", "é" * 9, "", None, "x" * 400, "<|hist|>" * 3]
    rnd = random.Random(5)
    rows = [(c, t, ("system" if t == 0 and c in (1, 3) else rnd.choice(["user", "assistant", None, "to\nol", "<|x"])), rnd.choice(nasty), "block") for c in (None, 1, 2, 3) for t in [*range(12), 11, None]]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, block string")
    want = defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((-(1 << 40) if t is None else t, r or "", x or ""))
    for options in ({}, {"budget": 120, "history_budget": 40, "max_history": 2, "block_turns": 5}, {"budget": 30, "history_budget": 0, "max_history": 0}):
        windows = chatformat.windows(df, **options)
        got = {r["conv_id"]: r for r in chatformat.digests(windows).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            turns.sort()
            said = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chatformat.digests(chatformat.windows(df.limit(0))).count() == 0


def slow_windows(turns: list[tuple[int, str, str]], cost, budget: int, history_budget: int, max_history: int, block_turns: int) -> list[tuple[bool, list[int], list[int]]]:
    """``(system turn in front, history, new turns)`` of each window, by places in the conversation."""
    system = 0 if turns[0][1] == "system" else None
    lead = cost(0) if system == 0 else 0
    out, at = [], 0
    while at < len(turns):
        block, first, size = turns[at][0] // block_turns, at, 0
        while at < len(turns) and turns[at][0] // block_turns == block and (at == first or size + cost(at) <= max(1, budget - history_budget - lead)):
            size += cost(at)
            at += 1
        front = system == 0 and first > 0
        spare = min(history_budget, budget - (lead if front else 0) - size)
        old = [i for i in range(max(0, first - max_history), first) if not (system == 0 and i == 0) and sum(cost(j) for j in range(i, first)) <= spare]
        out.append((front, old, list(range(first, at))))
    return out


@pytest.mark.parametrize("counted", [False, True])
def test_chat_windows_of_long_conversations(spark, counted: bool) -> None:
    rnd = random.Random(8)
    rows, sparse = [], [0, 1, 2, 900, 5000]
    for c in range(6):
        numbers = sparse if c == 5 else range(3 if c == 4 else 1300)
        rows += [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "".join(rnd.choice("ab <|\\é\u4e2d") for _ in range(rnd.choice([0, 3, 20, 60, 400 if c == 2 else 5]))), rnd.randrange(1, 90)) for t in numbers]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, tokens bigint").repartition(3)
    told = {(r["conv_id"], r["turn"]): (r["a"], r["b"]) for r in df.select("conv_id", "turn", chatformat.turn_text(F.col("role"), F.col("text")).alias("a"), chatformat.turn_text(F.col("role"), F.col("text"), chatformat.HISTORY).alias("b")).collect()}
    for options in ({"budget": 300, "history_budget": 90, "max_history": 2, "block_turns": 64}, {"budget": 200, "history_budget": 60, "max_history": 3, "block_turns": 1024}, {"budget": 100, "history_budget": 0, "max_history": 0, "block_turns": 10}):
        made = chatformat.windows(df if counted else df.drop("tokens"), **options).orderBy("conv_id", "block", "window").collect()
        for c in range(6):
            mine = sorted(r[1:] for r in rows if r[0] == c)
            cost = lambda i, c=c, mine=mine: mine[i][3] if counted else len(told[c, mine[i][0]][0].encode())
            want = slow_windows(mine, cost, **options)
            text = lambda front, old, new, c=c, mine=mine: (told[c, 0][1] if front else "") + "".join(told[c, mine[i][0]][1] for i in old) + "".join(told[c, mine[i][0]][0] for i in new)
            got = [w for w in made if w["conv_id"] == c]
            assert [w["formatted"] for w in got] == [text(*w) for w in want]
            assert [w["n_tokens"] for w in got] == [(cost(0) if f else 0) + sum(map(cost, old + new)) for f, old, new in want]
            assert all(w["n_tokens"] <= options["budget"] or len(new) == 1 and not old for w, (_, old, new) in zip(got, want, strict=True))


def test_chat_budget_holds_in_tokens_of_the_public_vocabulary(spark) -> None:
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer_files()["json_path"])
    texts = ["plain words in a row " * 9, "\u4f60\u597d\u4e16\u754c" * 40, "0123456789" * 20, "def f(x):\n\treturn x**2 # \u043f\u0440\u0438\u0432\u0435\u0442" * 4, "a\\b<|c" * 30]
    df = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], texts[(c + t) % 5]) for c in range(5) for t in range(40)], "conv_id bigint, turn bigint, role string, text string")
    made = chatformat.windows(df, budget=700, history_budget=200).collect()
    assert len(made) > 20
    assert all(len(bpe.encode(w["formatted"], add_special_tokens=False).ids) <= w["n_tokens"] <= 700 or w["formatted"].count(chatformat.TURN) == 1 for w in made)


# 3 and 4


@pytest.fixture(scope="module")
def learnable(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice("lorem ipsum dolor sit amet quam vel nisl".split()) + rnd.choice("abcdefgh") for _ in range(rnd.randrange(12, 60))]
        toxic, good = i % 6 == 0, i % 4 != 1
        if toxic:
            words += [rnd.choice(["scoundrel", "wretch", "vermin"]) for _ in range(2)]
        if not good:
            words = [w + "$$$" for w in words]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None), (1001, "")]
    return frame(spark, rows), spark.createDataFrame([*labels, (1000, None, None)], "doc_id bigint, quality int, toxic int"), labels


def test_toxicity(spark, learnable, none) -> None:
    docs, labels, truth = learnable
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    held = [(rows[i]["predicted"], t) for i, _, t in truth if rows[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).select("doc_id").collect()}
    assert kept == {i for i, r in rows.items() if not r["predicted"]} and toxicity.reject(docs, model).columns == docs.columns
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, other) == model  # labels of the held-out fold are never read
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).agg(F.max("score")).first()[0] < 1e-9


def test_nnpu_separates_without_negatives() -> None:
    rng = np.random.default_rng(0)
    pos, neg = (rng.random((300, 6)) < [0.8, 0.7, 0.1, 0.1, 0.5, 0.5]).astype(np.float32), (rng.random((700, 6)) < [0.1, 0.1, 0.4, 0.4, 0.5, 0.5]).astype(np.float32)
    theta = toxicity.nnpu_fit(pos[:150], np.concatenate([pos[150:], neg]), 150 / 850)
    z = lambda x: x @ theta[:-1] + theta[-1]
    assert (z(pos) > 0).mean() > 0.6 and (z(neg) < 0).mean() > 0.9


def test_quality_bayes(spark, learnable, none) -> None:
    docs, labels, truth = learnable
    rows = {r["doc_id"]: r for r in quality_bayes.quality(docs, labels).collect()}
    assert len(rows) == 602
    held = [(rows[i]["kept"], g) for i, g, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(k == bool(g) for k, g in held) / len(held) > 0.95
    assert quality_bayes.quality(none, labels).count() == 0
    assert quality_bayes.quality(docs, labels.limit(0)).count() == 602


def test_shrinkage(spark) -> None:
    groups = spark.createDataFrame([("a", 1000, 900 * 10**6), ("b", 1000, 100 * 10**6)], "host string, n bigint, s bigint")
    alike = spark.createDataFrame([("a", 1000, 500 * 10**6), ("b", 1000, 500 * 10**6)], "host string, n bigint, s bigint")
    assert quality_bayes.concentration(groups, F.lit(0.5)) < 5 and quality_bayes.concentration(alike, F.lit(0.5)) == quality_bayes.ALIKE


# 5


def slow_stats(text: str | None) -> tuple[int, int, int, int, int]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, docs, none) -> None:
    rows = odd_texts() + [(200, "a b c d e f " * 3), (201, "x y z w v x y z w v"), (202, "# | a b c d e f g h i j k")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        stats = slow_stats(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats, i
        assert r["base_failed"] == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0


def test_sketches_merge(spark) -> None:
    values = spark.range(5000).select((F.col("id") * 7919 % 100000).alias("v"), (F.col("id") % 3).alias("g"))
    bins = lambda df: {r["b"]: r["n"] for r in df.groupBy(quality_rules.sketch_bin(F.col("v")).alias("b")).agg(F.count("*").alias("n")).collect()}
    parts = sum((Counter(bins(values.where(f"g = {g}"))) for g in range(3)), Counter())
    assert parts == Counter(bins(values))
    assert all(b <= v < b + max(1, b / 16 + 1) for v, b in ((r["v"], r["b"]) for r in values.select("v", quality_rules.sketch_bin(F.col("v")).alias("b")).collect()))


# 6


def test_line_dedup(spark, docs, none) -> None:
    rows = odd_texts()
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        want[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    for parts in (1, 7):
        maps = linededup.drop_bitmaps(docs.select("doc_id", "text"), partitions=parts)
        got = {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.apply_bitmaps(docs.select("doc_id", "text"), maps).collect()}
        assert got == want
    assert sum(d for _, d, _ in want.values()) > 10
    assert linededup.dedup_lines(none).count() == 0
    assert linededup.dedup_lines(frame(spark, [(None, "x" * 30), (1, "x" * 30), (2, "x" * 30), (3, "x" * 30)])).where("doc_id is null").first()["n_dropped"] == 0


def test_line_dedup_keeps_columns_and_rows_of_one_id(spark, docs) -> None:
    clash = docs.withColumns({"kept_text": F.lit(1), "dropped": F.lit(2), "_dense": F.lit(3), "t": F.lit(4)})
    out = linededup.dedup_lines(clash)
    assert out.columns == [*(c for c in clash.columns if c != "kept_text"), "kept_text", "n_lines", "n_dropped"] and out.where("dropped = 2 and t = 4").count() == docs.count()
    assert linededup.without_repeats(clash).select("row.*").columns == clash.columns
    a, b = "a" * 30, "only here, never repeated anywhere"
    rows = [(1, a), (1, b), (2, a), (3, a), (3, f"{a}\n{b}x"), (1, a)]
    got = sorted((r["doc_id"], r["kept_text"], r["n_dropped"]) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(1, "", 1), (1, "", 1), (1, b, 0), (2, "", 1), (3, a, 0), (3, f"{a}\n{b}x", 0)]


def test_line_dedup_cuts_the_run_of_a_common_line(spark) -> None:
    rows = [(i, f"the line that every document has\n{'one of two lines in all' if i % 3 else 'a line of its own kind: %d' % i}") for i in range(3000)]
    maps = {r["doc_id"]: r["dropped"] for r in linededup.drop_bitmaps(frame(spark, rows).repartition(5), partitions=9).collect()}
    for i, _ in rows:
        assert (maps[i][0]["bits"] if i in maps else 0) == (i != 2999) + 2 * (i % 3 != 0 and i != 2999)


# 7


def slow_repeats(rows: list[tuple[int, str | None]], n: int = 50) -> dict[int, tuple]:
    least: dict[bytes, int] = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, b in raw.items():
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, none) -> None:
    want = slow_repeats(odd_texts())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(docs.repartition(11)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    assert suffixdedup.remove_repeats(none).count() == 0
    twice = suffixdedup.remove_repeats(docs.where("doc_id = 7").unionByName(docs.where("doc_id = 7"))).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    kept = suffixdedup.remove_repeats(frame(spark, [(None, "q" * 60), (5, "q" * 60)]), with_text=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in kept} == {None: 60, 5: 0}


@pytest.mark.parametrize(("block_bytes", "hot"), [(3000, 10**9), (3000, 2), (10**9, 512)])
def test_suffix_dedup_blocks(block_bytes: int, hot: int) -> None:
    """Small blocks, hot anchors, and one block, without Spark."""
    rows = odd_texts(120, seed=8)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int64()), pa.array([(t or "").encode() for _, t in rows], pa.binary())], names=["p", "a", "b"])
    blocks = {r.block: suffixdedup.Block(r.ids, r.sizes, r.data, 50, 16) for b in suffixdedup._to_blocks(iter([batch]), block_bytes) for r in b.to_pandas().itertuples()}
    asked = pd.concat([suffixdedup._ask(b, n) for n, b in blocks.items()])
    told = pd.concat([suffixdedup._shared_anchors(g, hot) for _, g in asked.groupby("bucket")])
    strings = pd.DataFrame([x for n, b in blocks.items() for x in suffixdedup._candidates(b, n, told[told["block"] == n], 50)], columns=["block", "bucket", "kind", "data"])
    marks = pd.concat([strings[strings["kind"] == 0], *(suffixdedup._settle(g, 50) for _, g in strings[strings["kind"] == 1].groupby("bucket"))])
    single = [*suffixdedup._hot_windows(iter([strings[strings["kind"] == 2]]), 50)]
    assert bool(single) == (hot == 2)
    if single:
        rows_of = pd.concat(single)
        rows_of = rows_of[rows_of["doc"] > rows_of.groupby("window")["doc"].transform("min")]
        marks = pd.concat([marks, *suffixdedup._hot_marks(iter([rows_of.groupby("block")["place"].apply(list).rename("places").reset_index()]))])
    out = pd.concat([suffixdedup._report(b, suffixdedup._covered(b, marks[marks["block"] == n], 50), False) for n, b in blocks.items()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples()} == slow_repeats(rows)


def test_suffix_dedup_of_a_passage_in_all_blocks(spark) -> None:
    passage = "a passage that every one of the documents has, word for word, and that is longer than a window"
    rows = [(i, f"{'q%d ' % i * 30}{passage}{' z%d' % i * 20}") for i in range(80)] + [(None, passage), (7, passage)]
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(frame(spark, rows).repartition(4), block_bytes=900, hot_blocks=3).collect()), key=str)
    want = slow_repeats([r for r in rows if r[0] is not None][:80])
    assert [x for x in got if x[0] not in (None, 7)] == sorted(((i, n, h) for i, (_, n, _, h) in want.items() if i != 7), key=str)
    assert [x[1] for x in got if x[0] is None] == [len(passage)] and sorted(x[1] for x in got if x[0] == 7) == [len(passage), want[7][1]]


def test_suffix_classes() -> None:
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 90))) for _ in range(30)] + [b"a" * 200]
    ends = np.cumsum([len(t) for t in texts])
    starts, klass = suffixdedup.suffix_classes(np.frombuffer(b"".join(texts), np.uint8), ends, 40)
    whole = b"".join(texts)
    seen: dict[bytes, int] = {}
    assert all(seen.setdefault(whole[s : s + 40], k) == k for s, k in zip(starts.tolist(), klass.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


# 8


def test_secrets(spark, docs, none) -> None:
    texts = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "token=abc token: abcdefgh", "token=token:abcdefgh", "PASSWORD:'hunter2hunter'", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "a" * 24, "pwd: \"hX9$kL2#mQ7!\"", "pwd: changeme2024", "ſecret=abcdefgh", "é token=ABCDEF", None, ""]
    got = {r["doc_id"]: r for r in secrets.digests(secrets.scan(frame(spark, list(enumerate(texts))))).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert got[i]["base_sha256"] == secrets.spans_sha256(told), t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == n for _, k, _ in found) for n in range(3))
    assert got[7]["spans"].startswith("guess:") and got[8]["spans"] == ""
    assert secrets.scan(none).count() == 0 and secrets.scan(docs).count() == len(odd_texts())
    assert secrets.redact("a token=abcdefgh b", secrets.scan_text("a token=abcdefgh b")) == "a [SECRET] b"


def test_guess_cost_is_the_least() -> None:
    assert secrets.guess_cost("") == 0 and secrets.guess_cost("password") == 1
    for easy in ("changeme2024", "qwerty123", "aaaaaaaaaaaa", "P@ssw0rd1", "20240131", "abcabcabcabc"):
        assert secrets.guess_cost(easy) < 7
    for hard in ("9f8a7c6b5d4e3f2a", "hX9$kL2#mQ7!"):
        assert secrets.guess_cost(hard) > 10


def piece_cost(value: str, a: int, b: int, ranks: dict[str, int]) -> float:
    """Of ``value[a:b]`` as one piece; infinite if it is none."""
    part, costs = value[a:b], [math.inf]
    low = part.lower()
    if b - a == 1:
        costs.append(1.0 if part.isdigit() else 1.2 if part.islower() else 1.4)
    look = low.translate(str.maketrans("4@301!|$57+", "aaeoiilsstt"))
    if look in ranks and b - a >= 3:
        costs.append(math.log10(10 * ranks[look]) + math.log10(4) * ((part != low) + (look != low)))
    if b - a >= 3:
        costs += [math.log10(40 * (b - a))] * (len(set(low)) == 1)
        for row in secrets.KEYS:
            costs += [math.log10(100 * (b - a))] * (low in row or low[::-1] in row)
    digits = re.sub("[-/._]", "", part)
    for form in ("%Y", "%Y%m%d", "%d%m%Y"):
        if digits.isdigit() and len(digits) >= 4 and part[0].isdigit() and part[-1].isdigit():
            for y, m, d in [(y, m, d) for y in range(1900, 2100) if str(y) in digits for m in range(1, 13) for d in range(1, 32)]:
                for mm in {str(m), f"{m:02}"}:
                    for dd in {str(d), f"{d:02}"}:
                        for sep in "", "-", "/", ".", "_":
                            if form == "%Y" and part == str(y):
                                costs.append(2.0)
                            elif part in (f"{y}{sep}{mm}{sep}{dd}", f"{dd}{sep}{mm}{sep}{y}"):
                                costs.append(math.log10(36500))
    for width in range(2, a + 1):
        if (b - a) % width == 0 and part == value[a - width : a] * ((b - a) // width):
            costs.append(math.log10(1 + (b - a) // width))
    return min(costs)


def test_guess_cost_agrees_with_all_segmentations() -> None:
    rnd, ranks = random.Random(6), secrets.ranks_of(["zebra", "corpus"])
    values = ["P@ssw0rd99", "qwertzebra", "2021qwe321", "abababxabx", "1/2/1999aa", "aAaAbBcCdD", "corpuscorp", "12-12-2012", "passwor", "Admin1admin", "lkjhgaaab9"]
    values += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 11))) for letters in ("ab1", "qwe12", "aA4@sS", "0123", "love12") for _ in range(12)]
    for value in values:
        n = len(value)
        cost = {(a, b): piece_cost(value, a, b, ranks) for a in range(n) for b in range(a + 1, n + 1)}

        def every(a: int, value: str = value, n: int = n, cost: dict = cost) -> float:
            return 0.0 if a == n else min(cost[a, b] + every(b) for b in range(a + 1, n + 1) if cost[a, b] < math.inf)

        assert abs(secrets.guess_cost(value, ranks) - every(0)) < 1e-9, value


def test_guess_cost_of_long_values() -> None:
    assert secrets.guess_cost("-" * 30_000) < 7 and secrets.guess_cost("abcd" * 5000) < 9
    rnd = random.Random(1)
    assert secrets.guess_cost("x9K!" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(5000))) > 5000


def test_planted_secrets_and_ordinary_words(spark) -> None:
    rnd = random.Random(11)
    words = [w for w in "authentication documentation environment placeholder credentials configuration process your goes development production internal response request header service account number repository deployment pipeline customer standard optional required variable function parameter".split()]
    prose = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(40)]
    ordinary = [f"{name}{rnd.choice([': ', '=', ' = '])}{rnd.choice(words)}{sep}{rnd.choice(words)}" for name in ("password", "credentials", "auth", "pwd") for sep in ("-", "_", ".") for _ in range(25)]
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#%&*"
    hidden = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(10, 24))) for _ in range(200)]
    planted = [f'{rnd.choice(prose)} {rnd.choice(["pwd", "client_secret", "passphrase", "private_key"])}: "{x}" and so on' for x in hidden]
    rows = list(enumerate([*prose, *ordinary, *planted, *planted[:5] * 20]))
    docs = frame(spark, rows)
    counts = secrets.word_counts(docs)
    dictionary = {r["w"]: r["n"] for r in counts.collect()}
    assert {"authentication", "documentation"} <= set(dictionary) and not {x.lower() for x in hidden} & set(dictionary)
    found = {r["doc_id"]: [(f["kind"], f["start"], f["end"]) for f in r["findings"]] for r in secrets.scan(docs, counts=counts).collect()}
    base = len(prose) + len(ordinary)
    right = sum(any(x in rows[base + i][1][a:b] for _, a, b in found[base + i]) for i, x in enumerate(hidden))
    # The fixed patterns take any value of six characters or more; only the costed ones are held against ordinary words.
    wrong = sum(any(k == "guess" for k, _, _ in found[i]) for i in range(base))
    bare = sum(any(k == 3 for _, k, _ in secrets.scan_text(t)) for _, t in rows[:base])
    assert right >= 0.99 * len(hidden) and wrong == 0 < bare
    # Against one text at a time with all words of the documents in one table.
    low = lambda n: n if n < 32 else n >> (n.bit_length() - 5) << (n.bit_length() - 5)
    ranks = secrets.ranks_of() | {w: len(secrets.WORDS) + sum(low(m) >= low(n) for m in dictionary.values()) for w, n in dictionary.items() if w not in secrets.WORDS}
    for i, t in rows:
        assert found[i] == [(secrets.KINDS[k], a, b) for a, k, b in secrets.scan_text(t, ranks=ranks)], t


def test_costed_values_are_joined_with_all_words_of_the_documents(spark) -> None:
    """Ties, repeated rows, null ids, a long value, and words beyond any list: a word costs what its frequency says."""
    names = ["".join(p) for p in itertools.product("bdfg", "aeiou", "lmnr", "aeiou", "stvz", "aeiou")]  # 8000 words, each in three texts
    texts = [" ".join(names[i : i + 400]) for i in range(0, len(names), 400)] * 3
    value = "-".join(names[:4])
    odd = [(7, f'pwd: "{value}"'), (7, f'pwd: "{value}"'), (None, f"pwd={value} passphrase={'Zq7#' * 3000}x"), (8, "pwd: " + "k3V" + "".join(random.Random(2).choice("abcdefxyz0123456789") for _ in range(20_000)))]
    docs = frame(spark, [*((100 + i, t) for i, t in enumerate(texts)), *odd])
    counts = secrets.word_counts(docs)
    assert counts.count() == len(names) and {r["n"] for r in counts.collect()} == {3}
    cost = secrets.guess_cost(value, secrets.ranks_of([*["zzzzzzzz" + str(i) for i in range(len(names) - 4)], *names[:4]]))
    assert abs(cost - secrets.guess_cost(value, {n: len(secrets.WORDS) + len(names) for n in names[:4]})) < 0.01 < secrets.guess_cost(value) - cost
    said = lambda c, bound: sorted((str(r["doc_id"]), len(r["findings"])) for r in secrets.scan(docs, min_cost=bound, counts=c).collect() if r["findings"])
    assert said(counts, cost + 0.1) == [("8", 1)] and said(None, cost + 0.1) == [("7", 1), ("7", 1), ("8", 1), ("None", 1)]
    assert secrets.scan(docs, counts=counts.limit(0)).count() == docs.count()


def test_references_are_no_secrets() -> None:
    """With the parameters of the query and a dictionary that no document takes part in."""
    ranks = secrets.ranks_of(secrets.vocabulary_words(tokenizer_files()["json_path"]))
    reported = lambda v: secrets.is_secret(v, 10.0, 0.9, ranks)
    for value in ("documentation", "getAuthenticationToken", "process.env.API_TOKEN", "{{ secrets.GITHUB_TOKEN }}", "https://example.com/login", "self.password_field", "${DATABASE_PASSWORD}"):
        assert not reported(value), value
    rnd = random.Random(8)
    for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789abcdef"):
        assert sum(reported("".join(rnd.choice(letters) for _ in range(rnd.randrange(14, 40)))) for _ in range(300)) >= 297, letters


# 9


def slow_tiling(a: list[int], b: list[int], k: int) -> list[tuple[int, int, int]]:
    ua, ub, tiles = [False] * len(a), [x == 0 for x in b], []
    while True:
        best, at = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n > best:
                    best, at = n, [(i, j)]
                elif n and n == best:
                    at.append((i, j))
        if best < k:
            return tiles
        for i, j in at:
            if not any(ua[i : i + best]) and not any(ub[j : j + best]):
                ua[i : i + best] = ub[j : j + best] = [True] * best
                tiles.append((i, j, best))


def test_tiling() -> None:
    rnd = random.Random(1)
    for round_ in range(300):
        letters = rnd.choice([1, 2, 4])
        a, b = ([rnd.randrange(letters) + 1 for _ in range(rnd.randrange(1, 40))] for _ in range(2))
        if rnd.random() < 0.5:
            b = b[:8] + a[len(a) // 2 :] + [0] + b[8:16] + a[: len(a) // 2]
        k = 1 + round_ % 4
        assert decontam.tile(np.array(a, np.uint64), np.array(b, np.uint64), k) == slow_tiling(a, b, k)


def test_tiling_of_a_repetitive_pair_is_quick() -> None:
    item = np.full(2000, 7, np.uint64)
    doc = np.array(([7] * 99 + [0]) * 200, np.uint64)
    began = time.process_time()
    tiles = decontam.tile(item, doc, 5)
    assert time.process_time() - began < 1
    assert [n for _, _, n in tiles] == [99] * 20 + [20] and [(p, q) for p, q, _ in tiles] == [(99 * i, 100 * i) for i in range(21)]
    few = decontam.tile(item[:120], doc[:400], 5)
    assert few == slow_tiling([7] * 120, doc[:400].tolist(), 5)


def slow_contaminated(rows, items, k: int = 5, share: float = 0.5) -> dict:
    tokens = lambda t: [w for run in re.findall(r"\w+", (t or "").lower()) for w in re.findall("[\u4e00-\u9fff\u3040-\u30ff]|[^\u4e00-\u9fff\u3040-\u30ff]+", run)]
    number: dict[str, int] = {}
    ids = lambda t: [number.setdefault(w, len(number) + 1) for w in tokens(t)]
    out = {}
    for item_id, t in items:
        a = ids(t)
        for doc_id, text in rows:
            n = sum(m for _, _, m in slow_tiling(a, ids(text), min(k, len(a)))) if a else 0
            if a and n >= share * len(a):
                out[doc_id, item_id] = n / len(a)
    return out


def test_decontamination(spark, docs, none) -> None:
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w, more = item.split(), "one common opening of five words " + " ".join(f"item{i}" for i in range(8))
    chinese = "\u7532\u4e59\u4e19\u4e01\u620a\u5df1\u5e9a\u8f9b\u58ec\u7678"
    rows = [*((i, t if i != 109 else "ab " * 50) for i, t in odd_texts(20)), (300, f"Before, {item.upper()}! after"), (301, " ".join(w[10:] + ["filler"] * 50 + w[:10])), (302, " ".join(w[:6])), (303, " ".join(reversed(w))), (304, f"x{chinese[5:]}\u3002{chinese[:5]}y"), (305, "it is too short by far"), (306, "short, too")]
    rows += [(400 + i, "one common opening of five words and then something else") for i in range(30)] + [(450, "then " + more)]
    items = [(1, item), (2, "too short"), (3, None), (4, item), (5, chinese), (6, more), (7, "?!")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    want = slow_contaminated(rows, items)
    assert {(300, 1), (301, 4), (304, 5), (305, 2), (450, 6)} <= set(want) and (306, 2) not in want and (302, 1) not in want
    for unfiltered in (False, True):
        with pytest.MonkeyPatch.context() as patch:
            if unfiltered:  # as for a benchmark too large to send
                patch.setattr(decontam, "MAX_SENT", 0)
            got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.contaminated(frame(spark, rows).repartition(11), bench.repartition(6)).collect()}
        assert got == want
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    twice = decontam.contaminated(frame(spark, [(None, item), (5, item), (5, "other words"), (5, item)]), bench).where("item_id = 1")
    assert sorted((r["doc_id"] for r in twice.collect()), key=str) == [5, 5, None]
    left = decontam.reject(frame(spark, [(None, item), (None, None), (5, item), (5, "other words"), (None, "clean")]).withColumnsRenamed({"fp": "t", "word": "row"}), bench)
    assert left.columns[-2:] == ["t", "row"] and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == [(5, "other words"), (None, "clean"), (None, None)]


# 10


def test_tokens_and_packing(spark, docs, none) -> None:
    from tokenizers import Tokenizer

    files = tokenizer_files()
    rows = [*odd_texts(), (400, "a <|endoftext|> b"), (401, "日本語 текст 😀"), (402, "x y z"), (403, "the end " * 3000)]
    exact = Tokenizer.from_file(files["json_path"])
    want = {}
    for i, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, n in enumerate([(len(ids) - 1) % 2048 + 1] + [2048] * ((len(ids) - 1) // 2048)):
            want[i, k] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
            at += n
    pieces = packing.token_pieces(frame(spark, rows), **files, with_ids=True)
    got = packing.pack(pieces, partitions=5).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(full) <= 1.05 * sum(n for _, n, _ in want.values()) / 2048 + 1
    joined = packing.packed_sequences(packing.pack(pieces))
    assert joined.agg(F.max(F.size("ids"))).first()[0] <= 2048
    assert packing.pack(packing.token_pieces(none, **files)).count() == 0


def test_plan_is_best_fit_decreasing() -> None:
    rnd = random.Random(2)
    for _ in range(60):
        capacity = rnd.choice([10, 50, 100])
        lengths = sorted((rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 200))), reverse=True)
        gaps: list[int] = []
        for n in lengths:
            fit = [i for i, g in enumerate(gaps) if g >= n]
            if fit:
                gaps[min(fit, key=lambda i: gaps[i])] -= n
            else:
                gaps.append(capacity - n)
        used: Counter[int] = Counter()
        for length, first, end, base, per, _ in packing.best_fit_plan(Counter(lengths), capacity):
            for r in range(end - first):
                used[base + r // per] += length
        assert len(used) == len(gaps) and max(used.values()) <= capacity and sum(used.values()) == sum(lengths)


def test_plan_stays_within_its_bound() -> None:
    rnd = random.Random(3)
    for capacity in (64, 257, 2048):
        tables = [{n: 10**9 for n in range(1, capacity + 1)}, {n: rnd.randrange(1, 10**6) for n in range(1, capacity + 1)}, {n: 1 for n in range(1, capacity + 1)}, {n: (capacity - n) ** 3 + 1 for n in range(1, capacity + 1)}]
        tables += [{n: int(10 ** rnd.uniform(0, 9)) for n in range(1, capacity + 1) if rnd.random() < 0.7} for _ in range(4)]
        for counts in tables:
            plan = packing.best_fit_plan(counts, capacity)
            assert len(plan) <= packing.plan_bound(capacity)
            assert sum(end - first for _, first, end, *_ in plan) == sum(counts.values())


def test_ranks_share_a_length(spark) -> None:
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50 + 1).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("ids_crc32"))
    ranks = packing.ranked_by_length(df, 6)
    bad = ranks.groupBy("length").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m")).where("n <> d or m <> n - 1")
    assert bad.count() == 0 and ranks.count() == 3000
