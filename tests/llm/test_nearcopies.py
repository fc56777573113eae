from __future__ import annotations

import random

import corpus_pipeline
from memtide.llm import nearcopies, simhash

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edited_copies(seed: int = 7) -> list[str]:
    """Texts of 60 to 400 words in families: copies with a few words changed, from nearly equal to rather different."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def brute(texts: list[str]) -> list[int]:
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sorted({x for x in label})


def keep(spark, rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]


def test_stage_links_what_brute_force_links(spark) -> None:
    texts = edited_copies()
    want = brute(texts)
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    apart = [min((prints[i] ^ prints[j]).bit_count() for j in range(len(texts)) if j != i) for i in set(range(len(texts))) - set(want)]
    assert max(apart) > 2  # a budget of two bits leaves some of them
    assert sorted(i for i, _ in keep(spark, list(enumerate(texts)))) == want


def test_links_across_components_of_large_clusters(spark, monkeypatch) -> None:
    """Texts a fixed step apart: each is a near copy of its neighbours alone, and the candidates tie them all together."""
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    rng = random.Random(3)
    line = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(line[i * 6 : i * 6 + 100]) for i in range(40)] + [" ".join(line[300 + i * 14 : 400 + i * 14]) for i in range(12)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h bigint, text string")
    sets = [nearcopies.shingles(nearcopies.words_of(t)) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if nearcopies.jaccard(sets[i], sets[j]) >= 0.8}
    for part in (lambda i: i, lambda i: min(i, 6), lambda i: i // 9):
        parted = spark.createDataFrame([(7, i, part(i)) for i in range(len(texts))], "cluster bigint, h bigint, part bigint")
        got = {(max(r["u"], r["v"]), min(r["u"], r["v"])) for r in nearcopies._across(parted, rows, 5, 0.8).collect()}
        assert got == {(i, j) for i, j in near if part(i) != part(j)}


def test_few_pairs_of_a_large_cluster_meet(spark) -> None:
    """Copies of one text, each edited elsewhere, are alike but seldom near copies: those that are meet, and few others."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(120), 1 if i % 50 == 0 else 5):
            copy[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [nearcopies.shingles(nearcopies.words_of(t)) for t in texts]
    alike = {(i, j) for i in range(300) for j in range(i) if (s := nearcopies.jaccard(sets[i], sets[j])) >= 0.5}
    near = {(i, j) for i, j in alike if nearcopies.jaccard(sets[i], sets[j]) >= 0.8}
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "h bigint, part bigint, text string")
    met = {(r["u"], r["v"]) for r in nearcopies._openings(rows, 5, 0.8).collect()}
    assert near and near <= met and len(met) < 300 < 10_000 < len(alike)
    parted = rows.selectExpr("7L as cluster", "h", "part")
    assert {(r["u"], r["v"]) for r in nearcopies._across(parted, rows.select("h", "text"), 5, 0.8).collect()} == near


def test_verdicts_are_by_row(spark) -> None:
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "a text of quite another kind here")
    assert sorted(keep(spark, [(3, a), (3, b), (4, b.upper()), (None, a), (None, c), (5, c), (None, "no copy of this is anywhere")]), key=repr) == sorted([(3, a), (3, b), (5, c), (None, "no copy of this is anywhere")], key=repr)


def test_shingles_of_one_text_are_not_counted(spark, monkeypatch) -> None:
    own = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").repartition(16)
    assert nearcopies._shared(frame(own), 5).count() == 0
    counts = [r["n"] for r in nearcopies._shared(frame([f"a b c d e {t}" for t in own]), 5).collect()]
    assert len(counts) == 1 and 16 < counts[0] <= 40
    # However few are counted, all that are alike meet.
    texts = edited_copies()[:60]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "h bigint, part bigint, text string")
    met = {(r["u"], r["v"]) for r in nearcopies._openings(rows, 5, 0.8).collect()}
    monkeypatch.setattr(nearcopies, "COUNTED", 1)
    blind = {(r["u"], r["v"]) for r in nearcopies._openings(rows, 5, 0.8).collect()}
    sets = [nearcopies.shingles(nearcopies.words_of(t)) for t in texts]
    near = {(i, j) for i in range(60) for j in range(i) if nearcopies.jaccard(sets[i], sets[j]) >= 0.8}
    assert near and near <= met and near <= blind
