"""Near copies by similarity, on the trie self-join of SimHash fingerprints: the join's links are confirmed on the texts.

Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At 0.8 a bit of their SimHash
differs with a probability of 0.15, far beyond the two bits that a single print can be searched for. So a text has many
prints, its faces: signs of random projections of its shingles. A face's budget is one bit in the first ones, as many of
those as tell the table's texts apart, and what 0.8 makes likely in all 64. One face finds a pair rarely, all of them
together miss one at the threshold with the probability ``MISS``; their number follows from the count of texts.

No link rests on prints: every one is confirmed by the exact similarity of both texts. Within a group of the walk a print
first meets its smallest partner; what that leaves in different components of one cluster meets wherever the sizes and
rarest shingles of two texts leave it open, so no pair that could join two components goes untested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.llm.components import connected_components
from memtide.llm.rows import by_size
from memtide.llm.scratch import materialize, release
from memtide.llm.simhash import BITS, GROUP, Budget, forest, linked_pairs, sorted_group, trie_groups
from memtide.llm.workers import frugal, give_back

MISS = 0.005
BLOCK = 128
RARE = 8
#: Words of 64 bits in the bitmap of a text's shingles.
WIDTH = 8
EPSILON = 1e-9
MAX_SENT = 1_000_000
#: Shingles that a task counts at once (8 MB), and texts whose shingles a task counts, more or less.
COUNTED, TEXTS = 1 << 20, 4096


def faces_for(n: int, similarity: float) -> tuple[int, Budget]:
    """How many faces ``n`` texts get, and the budget of a face."""
    differs = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi  # of two sets of one size, the worst case
    first = min(BITS, max(12, math.ceil(math.log2(max(1, n))) + 6))
    rest = BITS - first
    most = 1 + math.ceil(rest * differs + 2.5 * math.sqrt(rest * differs * (1 - differs)))
    found = 0.98 * ((1 - differs) ** first + first * differs * (1 - differs) ** (first - 1))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - found))), [(first, 1), (BITS, most)]


def face_prints(sets: list[np.ndarray], faces: int) -> np.ndarray:
    """Sorted shingle hashes of each text -> a row of ``faces`` 64-bit prints.

    Shingles vote with a sign in a hashed place of a vector; a Walsh-Hadamard transform turns that into votes for all bits.
    """
    places = 1 << max(6, (BITS * faces - 1).bit_length())
    votes = np.empty((len(sets), places), np.float32)
    for i, hashes in enumerate(sets):
        votes[i] = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(float), places)
    half = 1
    while half < places:
        pair = votes.reshape(len(sets), -1, 2, half)
        votes = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(sets), places)
        half *= 2
    bits = votes[:, np.random.default_rng(places).permutation(places)[: BITS * faces]] > 0
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words as :func:`simhash.fingerprint` takes them."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, and one without words has the empty one."""
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, max(1, len(words) - shingle + 1)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if min(len(a), len(b)) == 0:
        return 0.0
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def _sketched(docs: DataFrame, shingle: int, faces: int) -> DataFrame:
    """Per row ``(r, h, faces)``: all its columns, a hash of its text up to case and white space, and its prints."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                words = [words_of(t.as_py()) for t in part.column(1)]
                h = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words), np.uint64, len(words))
                prints = face_prints([shingles(w, shingle) for w in words], faces)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prints.size + 1, faces, dtype=np.int32)), pa.array(prints.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h.view(np.int64)), lists], names=["r", "h", "faces"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"r {rows.schema['r'].dataType.simpleString()}, h bigint, faces array<bigint>").withColumn("row", F.monotonically_increasing_id())


def _candidates(prints: DataFrame, faces: int, budget: Budget) -> DataFrame:
    """``(face, fp, head)`` -> ``(u, v, direct)``: a link of each print to its smallest partner in a group, and the few
    other edges that keep all candidates of a group connected."""

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order, every, mine = sorted_group(group)
        head = group["head"].to_numpy()[order]
        none = len(every)
        label, partner = np.arange(none), np.full(none, none)
        for p, q in linked_pairs(every[mine], every, budget, int(key[0]) // faces):
            p = mine[p]
            p, q = p[p != q], q[p != q]
            label = forest(label, p, q)
            np.minimum.at(partner, p, q)
            np.minimum.at(partner, q, p)
        u = np.flatnonzero(partner < none)
        stars = forest(np.arange(none), u, partner[u])
        w = np.flatnonzero((stars == np.arange(none)) & (label != stars))  # stars that a further edge ties to others
        frame = pd.DataFrame({"u": np.concatenate([head[u], head[w]]), "v": np.concatenate([head[partner[u]], head[label[w]]])})
        frame["direct"] = np.arange(len(frame)) < len(u)
        if none > 20_000:
            del every, mine, label, partner, order
            give_back()
        return frame[frame["u"] != frame["v"]]

    # A print has few partners here, so that larger nodes spare copies.
    return trie_groups(prints, budget, faces, leaf=1 << 18).groupBy(*GROUP).applyInPandas(walk, "u bigint, v bigint, direct boolean")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs ``(u, v)`` whose texts are as similar as asked."""
    both = pairs.join(texts.select(F.col("h").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("h").alias("v"), F.col("text").alias("tv")), "v")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                v = batch.column(1)[i].as_py()
                if v != last:  # rows come sorted by v from a merge join, in any order from others
                    last, seen = v, shingles(words_of(batch.column(3)[i].as_py()), shingle)
                keep[i] = jaccard(shingles(words_of(batch.column(2)[i].as_py()), shingle), seen) >= similarity
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["u", "v"])

    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def _across(parted: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links between different components inside clusters of candidates: ``(cluster, h, part)`` -> ``(u, v)``.

    A cluster of up to ``BLOCK`` texts is a group, which counts common shingles by postings. Texts of larger ones meet where
    they could be alike (:func:`_openings`), so that no task gathers a cluster and no text is sent to all others of it.
    """
    large = materialize(parted.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large", "none")
    n = large.agg(F.sum("n")).first()[0] or 0
    large = by_size(large.select("cluster"), MAX_SENT)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        h, part = group["h"].to_numpy(), group["part"].to_numpy()
        sets = [shingles(words_of(t), shingle) for t in group["text"]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        _, term = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(term, kind="stable")
        holder, begin = np.repeat(np.arange(len(sets)), size)[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ends = np.cumsum(size)
        for a in range(len(sets)):
            mine = term[ends[a] - size[a] : ends[a]]
            low, many = begin[mine], begin[mine + 1] - begin[mine]
            at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(holder[at], minlength=len(sets))
            b = np.flatnonzero((common / (size[a] + size - common) >= similarity) & (h < h[a]) & (part != part[a]))
            found.append((np.full(len(b), h[a]), h[b]))
        return pd.DataFrame({"u": np.concatenate([u for u, _ in found]), "v": np.concatenate([v for _, v in found])})

    few = parted.join(large, "cluster", "left_anti").join(texts, "h").groupBy("cluster").applyInPandas(test, "u bigint, v bigint")
    pairs = materialize(_openings(parted.join(large, "cluster", "left_semi").join(texts, "h").select("h", "part", "text"), shingle, similarity, n), "pairs", "none")
    return few.unionByName(_confirmed(pairs, texts, shingle, similarity))


def _shared(texts: DataFrame, shingle: int, n: int = 0) -> DataFrame:
    """About ``n`` rows ``(text)`` -> ``(s, n)``: in how many texts a shingle is, of those that several have.

    Most shingles of a text are its own. A task counts runs of ``COUNTED`` shingles and tells those that a run has twice,
    so that what it makes does not grow with the shingles that no two texts share. A count can fall short by a text a run.
    """

    @frugal
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(sets: list[np.ndarray]) -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["s", "n"])

        run, size = [], 0
        for text in (t for batch in batches for t in batch.column(0)):
            run.append(shingles(words_of(text.as_py()), shingle))
            size += len(run[-1])
            if size >= COUNTED:
                yield told(run)
                run, size = [], 0
        if run:
            yield told(run)

    tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, n // TEXTS)
    return texts.coalesce(tasks).mapInArrow(listed, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))


def _openings(rows: DataFrame, shingle: int, similarity: float, n: int = 0) -> DataFrame:
    """About ``n`` rows ``(h, part, text)`` -> the distinct pairs ``(u, v)`` of different parts that can be as similar as asked; all that are.

    A prefix join: with the shingles of all texts in one order, the common ones last, two texts that are alike have their
    first common shingle among the first of either, in the smaller one nearer still to its beginning. A pair that meets
    there goes on if what follows in both is long enough, and if the sets' bitmaps differ in few enough bits (a shingle
    that only one of two sets has changes one bit at most). The order has no bearing on what is found, only on how many
    meet: shingles that more than ``RARE`` texts have come by their number, unless ``MAX_SENT`` rows would not hold them.
    """

    held = _shared(rows.select("text"), shingle, n)
    held = materialize(held.where(F.col("n") > RARE), "held", "none")
    least = max(RARE, (held.agg(F.sum("n")).first()[0] or 0) // MAX_SENT)
    often = held.where(F.col("n") > least).toArrow()  # MAX_SENT rows of 16 bytes at most
    common, many = often.column("s").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(common)
    sent = rows.sparkSession.sparkContext.broadcast((common[order], many[order]))
    bits = [f"b{i}" for i in range(WIDTH)]

    @frugal
    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, many = sent.value
        for batch in batches:
            for h, part, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = shingles(words_of(text.as_py()), shingle)
                n = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    n = np.where(common[at] == s, many[at], 0)
                first = s[np.lexsort((s, n))][: len(s) - math.ceil(similarity * len(s) - EPSILON) + 1]
                k = len(first)
                odd = np.bincount(((s >> np.uint64(7)) % np.uint64(64 * WIDTH)).astype(np.int64), minlength=64 * WIDTH) % 2
                sketch = np.packbits(odd.astype(bool)).view(np.int64)
                fields = [np.full(k, h.as_py(), np.int64), np.full(k, part.as_py(), np.int64), np.full(k, len(s), np.int64), np.arange(k), first.view(np.int64), *(np.full(k, x, np.int64) for x in sketch)]
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in fields], names=["h", "part", "size", "place", "s", *bits])

    names = ["h", "part", "size", "place", "s", *bits]
    start = materialize(rows.select("h", "part", "text").mapInArrow(begun, ", ".join(f"{c} bigint" for c in names)), "starts", "none")
    x, y = (start.select("s", *(F.col(c).alias(f"{k}_{c}") for c in names if c != "s")) for k in "xy")
    y = y.where(F.col("y_place") <= F.col("y_size") - F.ceil(2 * similarity / (1 + similarity) * F.col("y_size") - EPSILON))
    both = F.col("x_size") + F.col("y_size")
    need = F.ceil(similarity / (1 + similarity) * both - EPSILON)  # so many shingles are common, at least
    smaller = (F.col("y_size") < F.col("x_size")) | ((F.col("y_size") == F.col("x_size")) & (F.col("y_h") < F.col("x_h")))
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits), F.lit(0))
    follows = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place")) >= need
    met = x.join(y, (x["s"] == y["s"]) & smaller & (F.col("x_part") != F.col("y_part")) & follows & (apart <= both - 2 * need))
    return met.select(F.greatest("x_h", "y_h").alias("u"), F.least("x_h", "y_h").alias("v")).distinct()


def near_links(classes: DataFrame, texts_of: DataFrame, faces: int, budget: Budget, shingle: int, similarity: float) -> DataFrame:
    """``(h, row, faces)``, a row a text, and ``(row, text)`` -> ``(u, v)``: edges of the components of all confirmed links."""
    every = classes.select(F.posexplode("faces").alias("face", "fp"), "h")
    prints = materialize(every.groupBy("face", "fp").agg(F.min("h").alias("head"), F.max("h").alias("tail")), "prints", "none", few=True)
    found = _candidates(prints.select("face", "fp", "head"), faces, budget)
    # Texts that share a whole print meet its smallest one.
    equal = materialize(prints.where("head <> tail").select("face", "fp", "head"), "equal", "none")
    alike = every.join(by_size(equal, MAX_SENT), ["face", "fp"]).where("h <> head").select(F.col("h").alias("u"), F.col("head").alias("v"), F.lit(True).alias("direct"))
    ends = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "direct")
    candidates = materialize(ends(found.unionByName(alike)).groupBy("u", "v").agg(F.max("direct").alias("direct")), "candidates", "none")
    release(prints)

    nodes = candidates.select(F.explode(F.array("u", "v")).alias("h")).distinct()
    texts = materialize(classes.select("h", "row").join(nodes, "h", "left_semi").join(texts_of, "row").select("h", "text"), "texts")
    links = materialize(_confirmed(candidates.where("direct").select("u", "v"), texts, shingle, similarity), "links")
    tied = connected_components(candidates.select("u", "v")).select(F.col("node").alias("h"), F.col("label").alias("cluster"))
    labels = connected_components(links).select(F.col("node").alias("h"), F.col("label").alias("part"))
    parted = texts.select("h").join(tied, "h", "left").join(labels, "h", "left").select("h", F.coalesce("cluster", "h").alias("cluster"), F.coalesce("part", "h").alias("part"))
    parted = materialize(parted, "parted", "none")
    # A cluster of two has no pair that was not confirmed or refused already.
    open_ = parted.groupBy("cluster").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("cluster")
    more = _across(parted.join(open_, "cluster", "left_semi"), texts, shingle, similarity)
    return materialize(links.unionByName(more), "links")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest doc_id.

    Verdicts are by row, not by doc_id: of rows that tie on doc_id one stays, rows of one doc_id whose texts are no near
    copies all stay, and a null doc_id comes after every other. Texts equal up to case and white space, and texts without
    words (null ones too), are copies of each other. Groups are connected components over the links. Extra columns may
    have any names; an empty table gives an empty one.
    """
    faces, budget = faces_for(docs.count(), similarity)
    keyed = materialize(_sketched(docs, shingle, faces), "keyed")
    rank = F.struct(F.col("r.doc_id").isNull().alias("late"), F.col("r.doc_id").alias("doc_id"), "row")
    firsts = materialize(keyed.select("h", rank.alias("rank")).groupBy("h").agg(F.min("rank").alias("first")), "classes")
    classes = materialize(keyed.select("row", "h", "faces").join(firsts.select(F.col("first.row").alias("row")), "row", "left_semi"), "faces", "none", few=True)
    links = near_links(classes, keyed.select("row", F.col("r.text").cast("string").alias("text")), faces, budget, shingle, similarity)
    final = connected_components(links).select(F.col("node").alias("h"), "label")
    placed = firsts.join(final, "h", "left").select(F.coalesce("label", "h").alias("label"), "first")
    winners = placed.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return keyed.join(winners, "row", "left_semi").select("r.*")
