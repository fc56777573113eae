"""Every stage of the pipeline on odd rows: nulls, empty tables, repeats, ids on several texts, columns of any name."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_text string, dropped int, row string, h bigint, r string, t bigint, n_lines string, _id int"
ITEM = " ".join(f"question{i} about" for i in range(12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    rnd = random.Random(1)
    root = tmp_path_factory.mktemp("tables")
    words = "lorem ipsum dolor sit amet vel quam nisl augue".split()
    text = lambda i: " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(40)) + (" vileword awfulword" if i % 4 == 0 else "")
    rows = [(i, text(i)) for i in range(400)]
    shared = "this is a line that several of the documents share"
    odd = [(900, None), (901, ""), (None, None), (902, " \n\t"), (None, text(1) + "\n" + shared), (903, f"{shared}\n{text(1)}"), (904, f"{text(1)}\n{shared.upper()}"), (905, f"{shared}\n{shared}\nthe end of it all"), (905, "another text under the same id " + text(1))]
    odd += [(906, rows[1][1]), (907, rows[1][1].replace("lorem", "LOREM")), (908, rows[5][1] + " one more"), (909, "intro " + ITEM + " outro"), (None, "null id, " + ITEM), (910, ITEM), (910, "clean text under an id that is contaminated elsewhere " + text(1)), (911, "x" * 300_000), (3, rows[3][1])]
    full = [(i, t, "en", "s", len(t) if t else None, "kept", 7, "row", 1, "r", 2, "lines", 3) for i, t in [*rows, *odd]]
    spark.createDataFrame(full, FIELDS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def pairs(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_each_stage_against_a_plain_version(spark, folder: str) -> None:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pairs(docs)

    left = cp.drop_toxic(spark, docs, folder)
    assert left.columns == docs.columns
    told = [(i, t) for i, t in rows if i is not None and i < 400]
    assert sum(((i, t) in pairs(left)) == (i % 4 != 0) for i, t in told) >= 0.97 * len(told)
    assert {(900, None), (901, ""), (None, None)} <= set(pairs(left))

    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    want = Counter()
    for (i, t), n in rows.items():
        gone = lambda x, i=i: i is not None and len(holders[key(x)]) >= 3 and i != max(holders[key(x)])
        want[i, "\n".join(x for x in (t or "").split("\n") if not gone(x))] += n
    short = cp.drop_repeated_lines(spark, docs, folder)
    assert short.columns == docs.columns and pairs(short) == want
    assert all(r["n_chars"] == len(r["text"]) and (r["kept_text"], r["dropped"], r["n_lines"]) == ("kept", 7, "lines") for r in short.collect())

    words = {x: (x[1] or "").lower().split() for x in rows}
    sets = {x: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for x, w in words.items()}
    label = {x: x for x in rows}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    for a in order:
        for b in order:
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = sorted((label[a], label[b]), key=order.index, reverse=True)
                label = {x: new if y == old else y for x, y in label.items()}
    one = cp.drop_near_duplicates(spark, docs, folder)
    assert one.columns == docs.columns
    least = defaultdict(list)
    for x in order:
        least[label[x]].append(x)
    got = pairs(one)
    assert sum(got.values()) == len(least)
    for group in least.values():  # the smallest id stays; which of its texts, if they are copies, is left open
        assert sum(got[x] for x in group if x[0] == group[0][0]) == 1

    clean = cp.drop_contaminated(spark, docs, folder)
    assert clean.columns == docs.columns and pairs(clean) == Counter({x: n for x, n in rows.items() if ITEM not in (x[1] or "")})

    packed = cp.pack_sequences(spark, docs, folder)
    assert packed.where("piece = 0").count() == docs.count()
    by = defaultdict(list)
    for r in packed.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0 and sum(places[-1]) <= 2048


def test_empty_tables(spark, folder: str) -> None:
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run_leaves_its_result_alone(spark, folder: str) -> None:
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/memtide"
    import os

    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = cp.run(spark, folder)
    assert out.count() > 0
    assert len(set(os.listdir(root)) - before) == 1
