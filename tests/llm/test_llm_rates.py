"""Rates, cut-offs and scores against a plain recomputation, and odd rows in the learned operators."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from memtide.llm import quality_bayes, quality_rules, toxicity
from memtide.llm.queries import QUERIES

FIELDS = "doc_id bigint, text string, host string, path string, n bigint, score double, p int, f string, _id bigint"


def sites(seed: int = 4) -> list[tuple]:
    """Documents of good, bad, mixed and tiny sites; in bad ones most are full of symbols and repeats."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(3, 9)))
    rows = []
    shares = {("good.org", "/a"): (150, 0.97), ("good.org", "/b"): (150, 0.95), ("bad.com", "/x"): (150, 0.05), ("bad.com", "/y"): (120, 0.1), ("mixed.net", "/fine"): (120, 0.95), ("mixed.net", "/spam"): (120, 0.05), ("good.org", "/new"): (2, 0.0), ("bad.com", "/new"): (2, 1.0), ("tiny.io", None): (1, 1.0), (None, "/"): (30, 0.5)}
    for (host, path), (n, share) in shares.items():
        for _ in range(n):
            good = rnd.random() < share
            words = [word() for _ in range(rnd.randrange(20, 60))]
            text = " ".join(words) if good else " ".join(w + rnd.choice(["!!", "##", " $$$ BUY BUY"]) for w in words[:8] * 3)
            rows.append((len(rows), text, host, path, good))
    return rows


def odds(p: float) -> float:
    return math.log(p / (1 - p))


def slow_rates(rows: list[dict], base: float) -> dict:
    """``(host, path) -> (host rate, path rate)`` from the evidence of the rows alone."""
    unit = 10**6
    prob = [round(unit / (1 + math.exp(-(r["evidence"] + base)))) for r in rows]
    by_path, by_host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for r, p in zip(rows, prob, strict=True):
        for t in (by_path[r["host"], r["path"]], by_host[r["host"]]):
            t[0] += 1
            t[1] += p

    def strength(groups: list[tuple[int, int, float]]) -> float:
        n, k = sum(g[0] for g in groups), len(groups)
        v = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
        d = sum(g[0] * (g[1] / (g[0] * unit) - g[2]) ** 2 for g in groups)
        between = (d - (k - 1) * v) / (n - sum(g[0] ** 2 for g in groups) / n)
        return max(2.0, v / between - 1) if between > 0 else quality_bayes.ALIKE

    rate = sum(prob) / (len(prob) * unit)
    k_host = strength([(n, s, rate) for n, s in by_host.values()])
    host = {h: (s / unit + k_host * rate) / (n + k_host) for h, (n, s) in by_host.items()}
    k_path = strength([(n, s, host[h]) for (h, _), (n, s) in by_path.items()])
    return {(h, p): (host[h], (s / unit + k_path * host[h]) / (n + k_path)) for (h, p), (n, s) in by_path.items()}


def test_rates_of_hosts_and_paths(spark, monkeypatch) -> None:
    rows = sites()
    docs = spark.createDataFrame([(i, t, h, p, 1, 0.5, 1, "f", 9) for i, t, h, p, _ in rows], FIELDS).repartition(3)
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, _, _, g in rows], "doc_id bigint, quality int, toxic int")
    model = quality_bayes.train(docs, labels)
    for sent in (quality_bayes.MAX_SENT, 0):  # sites that go to every task, and sites that are joined
        monkeypatch.setattr(quality_bayes, "MAX_SENT", sent)
        got = {r["doc_id"]: r.asDict() for r in quality_bayes.quality(docs, labels, host="host", path="path").collect()}
        assert len(got) == len(rows)
        told = [got[i] | {"host": h, "path": p} for i, _, h, p, _ in rows]
        want = slow_rates(told, model.base)
        for r in told:
            host_rate, path_rate = want[r["host"], r["path"]]
            assert abs(r["host_rate"] - host_rate) < 1e-9 and abs(r["path_rate"] - path_rate) < 1e-9
            assert abs(r["score"] - 1 / (1 + math.exp(-(r["evidence"] + odds(path_rate))))) < 2e-6 and r["kept"] == (r["score"] >= 0.5)
    # Sites speak for themselves where they are large, and follow their host where they are not.
    assert want["mixed.net", "/fine"][1] > 0.8 and want["mixed.net", "/spam"][1] < 0.2
    assert want["good.org", "/new"][1] > 0.3 and want["bad.com", "/new"][1] < 0.7  # two documents, all bad, all good
    # One text on two sites: equal evidence, and a score that goes with the site.
    pair = spark.createDataFrame([(i, "some words in the middle", h, p, 1, 0.5, 1, "f", 9) for i, h, p in ((9001, "mixed.net", "/fine"), (9002, "mixed.net", "/spam"))], FIELDS)
    good, bad = quality_bayes.quality(docs.unionByName(pair), labels, host="host", path="path").where("doc_id > 9000").orderBy("doc_id").collect()
    assert good["evidence"] == bad["evidence"] and odds(good["path_rate"]) - odds(bad["path_rate"]) > 2 and good["score"] >= bad["score"]


def test_hosts_and_paths_of_urls(spark) -> None:
    urls = {"https://Example.ORG/blog/2024/x?q=1": ("example.org", "/blog"), "http://a.b:8080": ("a.b", "/"), "http://a.b//x/": ("a.b", "/x"), "no url at all": (None, None), "": (None, None), None: (None, None)}
    df = spark.createDataFrame([(u, "old") for u in urls], "url string, host string")
    assert {r["url"]: (r["host"], r["path"]) for r in quality_bayes.by_url(df).collect()} == urls


def test_text_of_pages(spark) -> None:
    pages = {"<html><head><title>t</title></head><body><p>one &amp;lt; two</p><script>var a='</p>';</script><STYLE>p{}</STYLE >three<!-- x --></body>": "one &lt; two three", "<header>kept</header>": "kept", "": "", None: None, "a < b": "a < b"}
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert {r["html"]: r["t"] and " ".join(r["t"].split()) for r in df.select("html", quality_bayes.page_text().alias("t")).collect()} == pages


def test_rates_of_pages(spark) -> None:
    """Every page has the rates that a plain recomputation makes of the evidence of all pages."""
    root = Path("/root/testdata/sf0.001")
    if not root.is_dir():
        pytest.skip("no driver tables")
    urls = {r["page_id"]: r for r in quality_bayes.by_url(spark.read.parquet(f"{root}/pages.parquet")).select("page_id", "host", "path").collect()}
    got = [r.asDict() | {"host": urls[r["page_id"]]["host"], "path": urls[r["page_id"]]["path"]} for r in QUERIES["op_pages_quality"](spark, str(root)).collect()]
    assert sorted(r["page_id"] for r in got) == sorted(urls) and len({r["evidence"] for r in got}) > len(got) // 2
    model = quality_bayes.train(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    want = slow_rates(got, model.base)
    for r in got:
        host_rate, path_rate = want[r["host"], r["path"]]
        assert abs(r["host_rate"] - host_rate) < 1e-9 and abs(r["path_rate"] - path_rate) < 1e-9
        assert abs(r["score"] - 1 / (1 + math.exp(-(r["evidence"] + odds(path_rate))))) < 2e-6


def test_non_negative_risk() -> None:
    """The step is the risk's gradient by finite differences, and turns where the negatives' loss falls below zero."""
    rnd = np.random.default_rng(3)
    pos, unl = (rnd.random((40, 6)) < 0.6).astype(float), (rnd.random((90, 6)) < 0.3).astype(float)
    soft = lambda z: np.log1p(np.exp(z))

    def parts(theta: np.ndarray, prior: float) -> tuple[float, float, float]:
        zp, zu = pos @ theta[:-1] + theta[-1], unl @ theta[:-1] + theta[-1]
        return prior * soft(-zp).mean(), soft(zu).mean() - prior * soft(zp).mean(), 0.05 * (theta[:-1] ** 2).sum()

    seen = set()
    for prior in (0.1, 0.3, 0.8):
        for scale in (0.1, 1.0, 3.0):
            theta = rnd.normal(size=7) * scale + 0.5
            rest, grad = toxicity.nnpu_step(theta, pos, unl, prior, 0.1)
            assert abs(rest - parts(theta, prior)[1]) < 1e-9
            seen.add(rest >= 0)
            aim = lambda t, up=rest >= 0, prior=prior: sum(parts(t, prior)) if up else parts(t, prior)[2] - parts(t, prior)[1]
            for i in range(7):
                step = np.eye(7)[i] * 1e-5
                assert abs((aim(theta + step) - aim(theta - step)) / 2e-5 - grad[i]) < 1e-6
    assert seen == {True, False}


def test_prior_and_features_of_unlabelled_texts(spark) -> None:
    """Counts, class prior and chosen features against a plain recomputation; only ``toxic = 1`` outside the fold is read."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice([f"word{k}" for k in range(60)]) for _ in range(12)) + (" slurone slurtwo" if i % 5 == 0 else " slurone" if i % 50 == 3 else "")) for i in range(900)]
    docs = spark.createDataFrame([*rows, rows[7], (None, "slurone")], "doc_id bigint, text string").repartition(3)
    toxic = [i for i, _ in rows if i % 15 == 0]  # a third of the toxic ones are confirmed; the rest has no label
    labels = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in range(1, 60, 7) if i % 15], "doc_id bigint, toxic int")
    inside = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    pos = [set(toxicity.document_features(t)) for i, t in rows if i in toxic and inside(i)]
    unl = [set(toxicity.document_features(t)) for i, t in rows if inside(i)]
    a, b = (Counter(f for x in part for f in x) for part in (pos, unl))
    least = []
    for f in a:
        p, u = a[f] / len(pos), b[f] / len(unl)
        if a[f] > 9 and p > 0:
            least.append((u + math.sqrt(u / len(unl))) / (p - math.sqrt(p * (1 - p) / len(pos))))
    prior, want = min(least), set()
    for f in a:
        e = (b[f] + 1) * len(pos) / len(unl)
        if a[f] >= 3 and prior * a[f] / len(pos) >= 0.5 * b[f] / len(unl) and a[f] > e and math.sqrt(2 * (a[f] * math.log(a[f] / e) - a[f] + e)) >= 4:
            want.add(f)
    model = toxicity.train(docs, labels)
    assert abs(model.prior - prior) < 1e-9 and abs(prior - 0.2) < 0.05  # a fifth is toxic, a fifteenth confirmed
    assert set(model.weights) == want and want
    assert toxicity.train(docs, labels.where("toxic = 1")) == model
    by = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(by[i] == (i % 5 == 0) for i, _ in rows if i % 50 != 3)


def test_prior_is_not_that_of_rare_features(spark) -> None:
    """Many rare features that no unlabelled text happens to have say little; one that a fifth of the toxic texts have does."""
    rare = [(i, 12 + i % 20, 0) for i in range(3000)]
    counts = spark.createDataFrame([*rare, (9000, 1200, 240), (9001, 600, 900)], "f bigint, a bigint, b bigint")
    assert 0.09 < toxicity.class_prior(counts, 6000, 12000) < 0.12


def test_too_few_confirmed_texts_reject_nothing(spark) -> None:
    docs = spark.createDataFrame([(i, " ".join(f"word{chr(97 + i % 26)}{chr(97 + (i * k) % 23)}" for k in range(5))) for i in range(120)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 9)) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert not model.weights and toxicity.reject(docs, model).count() == 120


def test_odd_rows_are_scored(spark) -> None:
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice("lorem ipsum dolor sit amet vel".split()) for _ in range(30))
    rows = [(i, good() + (" vileword awfulword" if i % 4 == 0 else "")) for i in range(400)]
    long = "lorem ipsum " * 60_000
    rows += [(500, long), (501, long + "vileword awfulword vileword awfulword"), (502, None), (503, ""), (1, rows[1][1]), (1, rows[1][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(i, t, None, "p", 1, 0.5, 1, "f", 9) for i, t in rows], FIELDS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(400)] * 2, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.weights) and len(model.weights) <= 600
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[501] == 1 and by[500] == by[502] == by[503] == 0 and by[None] == 1
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and left.count() == sum(1 for r in got if not r["predicted"])
    out = quality_bayes.quality(docs, labels, host="host", path="path").collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1 and len({r["host_rate"] for r in out}) == 1


def test_cut_offs_of_groups(spark) -> None:
    rnd = random.Random(5)
    rows = []
    for lang, source, n, shout in (("en", "a", 300, 0.02), ("en", "b", 12, 0.6), (None, "a", 40, 0.1), ("de", None, 150, 0.3), ("fr", "only", 1, 0.9)):
        for _ in range(n):
            words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 50))]
            words = [w.upper() if rnd.random() < shout * rnd.choice([0.5, 1, 1, 1.5]) else w + "#" * (rnd.random() < 0.02) for w in words]
            rows.append((len(rows), " ".join(words) + "\nsame line" * rnd.choice([0, 0, 2]), lang, source))
    rows += [(3, rows[3][1], "en", "a"), (len(rows), " ".join(f"WORD{i}!!" for i in range(30)), "en", "b"), (len(rows) + 1, " ".join("x" * 90 + str(i) for i in range(30)), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    names = list(quality_rules.RULES)
    stats = [r.asDict() for r in quality_rules.ratios(quality_rules.base_stats(df)).collect()]
    passed = [r for r in stats if r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]

    def low_bin(v: int) -> int:
        shift = max(v.bit_length() - 5, 0)
        return v >> shift << shift

    def fences(group: list[dict]) -> dict:
        out = {}
        for name in names:
            bins = sorted(low_bin(r[name]) for r in group if r[name] is not None)
            if bins:
                tail, below = quality_rules.RULES[name]
                low, mid, high = (next(b for k, b in enumerate(bins) if 1000 * (k + 1) >= part * len(bins)) for part in (1000 - tail, 500, tail))
                mid, high = (b + (1 << max(b.bit_length() - 5, 0)) - 1 for b in (mid, high))
                out[name] = (high + quality_rules.FENCE * (high - mid), low - quality_rules.FENCE * (mid - low) if below else -math.inf)
        return out

    drawn = lambda n, own, up: {k: tuple((n * o + quality_rules.PRIOR * u) / (n + quality_rules.PRIOR) for o, u in zip(own.get(k, up[k]), up[k], strict=True)) for k in up}
    every = fences(passed)
    langs = {x: drawn(len(g), fences(g), every) for x in {r["lang"] for r in passed} for g in [[r for r in passed if r["lang"] == x]]}
    groups = {k: drawn(len(g), fences(g), langs[k[0]]) for k in {(r["lang"], r["source"]) for r in passed} for g in [[r for r in passed if (r["lang"], r["source"]) == k]]}
    want = Counter()
    for r in stats:
        limit = groups.get((r["lang"], r["source"]))
        fails = any(r[n] is not None and limit and not limit[n][1] <= r[n] <= limit[n][0] for n in names)
        want[r["doc_id"], r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"] and not fails] += 1
    got = Counter((r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(df).collect())
    assert got == want
    dropped = [r for r in passed if want[r["doc_id"], False]]
    assert len(dropped) >= 2
    alone = lambda limits: sum(any(not limits(r)[n][1] <= r[n] <= limits(r)[n][0] for n in names if r[n] is not None) for r in passed)
    assert len({alone(lambda r: every), alone(lambda r: langs[r["lang"]]), alone(lambda r: groups[r["lang"], r["source"]])}) > 1
