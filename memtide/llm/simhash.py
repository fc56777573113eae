"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are walked as a binary trie. A pair of nodes carries the bits in which the two prefixes differ and is
dropped as soon as they exceed the budget, which may be smaller for the first bits. The first levels are done by Spark: a
node is the top ``depth`` bits, node pairs within the budget are listed from the table of nodes, pairs that hold too many
fingerprints are split by four more bits, and every node's fingerprints meet those of its surviving partners in bounded
groups. The rest of the walk is vectorised numpy in that group. Each group returns a spanning forest of its links, never
all pairs, and a connected-components pass joins the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memtide.llm.components import connected_components
from memtide.llm.scratch import materialize, release
from memtide.llm.workers import frugal

BITS = 64
SEED = 42
GROUP = ("part", "node", "chunk")


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 when it has no word."""
    words = (data or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 1024):  # bounded memory for any length; 255 rows fit a byte counter
        part = hashes[at : at + 255 * 1024].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1)
        if short := -len(bits) % 255 if len(bits) > 255 else 0:
            bits = np.concatenate([bits, np.zeros((short, BITS), np.uint8)])
        votes += bits.reshape(-1, min(255, len(bits)), BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fp)``; ``fp`` is the fingerprint's bit pattern as a signed bigint."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id bigint, fp bigint")


#: ``(depth, bits)``: at most so many differing bits in the first ``depth`` bits; depths rise, and the last is BITS.
Budget = list[tuple[int, int]]


def allowed(budget: Budget, depth: int) -> int:
    return min(bits for at, bits in budget if at >= depth)


def linked_pairs(own: np.ndarray, other: np.ndarray, budget: Budget, depth: int = 0, limit: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted uint64 arrays whose values are within the budget, by the trie walk, a part at a time.

    ``depth``: the walk starts there, from every pair of prefixes of so many bits. About ``limit`` node pairs are looked
    at together, so that the memory is bounded however many pairs there are.
    """
    if not len(own) or not len(other):
        return

    def nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = x >> np.uint64(BITS - depth) if depth else np.zeros(len(x), np.uint64)
        value, first = np.unique(top, return_index=True)
        return value, first, np.append(first[1:], len(x))

    (va, la, ha), (vx, lx, hx) = nodes(own), nodes(other)
    i, j = np.repeat(np.arange(len(va)), len(vx)), np.tile(np.arange(len(vx)), len(va))
    diff = np.bitwise_count(va[i] ^ vx[j]).astype(np.int64)
    near = diff <= allowed(budget, depth)
    i, j = i[near], j[near]
    waiting = [(depth, (la[i], ha[i], lx[j], hx[j], diff[near]))]
    while waiting:
        level, front = waiting.pop()
        if len(front[0]) > limit:
            waiting += [(level, tuple(v[at : at + limit] for v in front)) for at in range(0, len(front[0]), limit)]
            continue
        a0, a1, x0, x1, diff = front
        na, nx = a1 - a0, x1 - x0
        few = na * nx <= 16
        if few.any():  # so few are compared directly
            fa, fx, size, wide = a0[few], x0[few], (na * nx)[few], nx[few]
            of = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            p, q = fa[of] + k // wide[of], fx[of] + k % wide[of]
            apart = own[p] ^ other[q]
            near = np.ones(len(p), bool)
            for at, bits in budget:
                near &= np.bitwise_count(apart >> np.uint64(BITS - at)) <= bits
            yield p[near], q[near]
        a0, a1, x0, x1, diff = (v[~few] for v in (a0, a1, x0, x1, diff))
        if not len(a0):
            continue
        half = np.uint64(1 << (BITS - 1 - level))

        def split(x: np.ndarray, lo: np.ndarray, half: np.uint64 = half) -> np.ndarray:
            return np.searchsorted(x, (x[lo] & ~(half | (half - np.uint64(1)))) | half)

        am, xm = split(own, a0), split(other, x0)
        a0, a1, x0, x1, diff = (np.concatenate(v) for v in ((a0, am, a0, am), (am, a1, am, a1), (x0, xm, xm, x0), (xm, x1, x1, xm), (diff, diff, diff + 1, diff + 1)))
        keep = (a1 > a0) & (x1 > x0) & (diff <= allowed(budget, level + 1))
        if keep.any():
            waiting.append((level + 1, tuple(v[keep] for v in (a0, a1, x0, x1, diff))))


def forest(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``label``, the smallest index reachable so far, after the edges ``(u, v)`` are added."""
    u, v = label[u], label[v]
    u, v = u[u != v], v[u != v]
    now = np.arange(len(label))
    while len(u):
        least = np.minimum(now[u], now[v])
        new = now.copy()
        np.minimum.at(new, now[u], least)
        np.minimum.at(new, now[v], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == now).all():
            break
        now = new
    return now[label]


def _prefix(depth: int, column: str = "fp") -> F.Column:
    return F.shiftrightunsigned(F.col(column), BITS - depth) if depth else F.lit(0).cast("bigint")


def _node_pairs(prints: DataFrame, depth: int, budget: Budget, group_cap: int) -> list[tuple[int, DataFrame]]:
    """``(depth, pairs)`` per level; pairs has ``(face, a, b)`` with ``a <= b``. Pairs above ``group_cap`` prints are split on."""
    masks = [0, *(sum(1 << i for i in bits) for k in range(1, allowed(budget, depth) + 1) for bits in combinations(range(depth), k))]
    nodes = materialize(prints.groupBy("face", _prefix(depth).alias("a")).agg(F.count("*").alias("n")), "trie")
    b_nodes = nodes.select("face", F.col("a").alias("b"), F.col("n").alias("nb"))
    pairs = nodes.select("face", "a", "n", F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))).alias("mask"))
    pairs = pairs.select("face", "a", "n", F.col("a").bitwiseXOR(F.col("mask")).alias("b"), F.bit_count("mask").alias("diff")).where("a <= b").join(b_nodes, ["face", "b"])
    out, step = [], 4
    while True:
        pairs = materialize(pairs.select("face", "a", "b", "diff", "n", "nb"), "pairs")
        heavy = pairs.where((F.col("n") + F.col("nb") > group_cap) & F.lit(depth < BITS))
        out.append((depth, pairs.where((F.col("n") + F.col("nb") <= group_cap) | F.lit(depth >= BITS))))
        if heavy.isEmpty():
            return out
        step = min(step, BITS - depth)
        depth += step
        kids = materialize(prints.groupBy("face", _prefix(depth).alias("k")).agg(F.count("*").alias("nk")), "trie")
        kids = kids.withColumn("p", F.shiftrightunsigned("k", step))
        left = heavy.select("face", "a", "b", "diff").join(kids.select("face", F.col("p").alias("a"), F.col("k").alias("ka"), F.col("nk").alias("n")), ["face", "a"])
        both = left.join(kids.select("face", F.col("p").alias("b"), F.col("k").alias("kb"), F.col("nk").alias("nb")), ["face", "b"])
        mask = F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND(F.lit((1 << step) - 1))
        pairs = both.withColumn("diff", F.col("diff") + F.bit_count(mask)).where((F.col("diff") <= allowed(budget, depth)) & ((F.col("a") < F.col("b")) | (F.col("ka") <= F.col("kb"))))
        pairs = pairs.select("face", F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "diff", F.when(F.col("ka") <= F.col("kb"), F.col("n")).otherwise(F.col("nb")).alias("n"), F.when(F.col("ka") <= F.col("kb"), F.col("nb")).otherwise(F.col("n")).alias("nb"))


def trie_groups(prints: DataFrame, budget: Budget, faces: int = 1, leaf: int = 1 << 16, group_cap: int = 1 << 20) -> DataFrame:
    """``(face, fp, ...)``, distinct by the two -> ``(part, node, chunk, own, fp, ...)``: the groups in which the walk goes on.

    Each holds a node's prints (``own``) and those of nodes within the budget of it; ``part`` is depth * faces + face. The
    depth follows from the count of prints, so that a node has about ``leaf`` of them at any size; a node whose partners
    have more than ``group_cap`` together is dealt out as several groups.
    """
    n = -(-prints.count() // faces)
    # One face is cut at least as finely as the session's partitions ask for, up to 64 nodes; many are many groups anyway.
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")) if faces == 1 else 0
    depth = min(40, max(min(6, (2 * partitions).bit_length()), math.ceil(math.log2(max(1, n) / leaf)))) if n else 0
    more = [c for c in prints.columns if c != "face"]
    dealt = None
    for level, pairs in _node_pairs(prints, depth, budget, group_cap):
        before = Window.partitionBy("face", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        pairs = pairs.select("face", "a", "b", F.floor(F.coalesce(F.sum("nb").over(before), F.lit(0)) / group_cap).alias("chunk"))
        placed = prints.withColumn("node", _prefix(level))
        own = placed.join(pairs.select("face", F.col("a").alias("node"), "chunk").distinct(), ["face", "node"]).withColumn("own", F.lit(True))
        far = placed.withColumnRenamed("node", "b").join(pairs.where("a <> b"), ["face", "b"]).withColumnRenamed("a", "node").withColumn("own", F.lit(False))
        rows = own.unionByName(far.select(own.columns)).select((F.col("face") + level * faces).cast("int").alias("part"), "node", "chunk", "own", *more)
        dealt = rows if dealt is None else dealt.unionByName(rows)
    return dealt


def trie_links(prints: DataFrame, budget: int = 2, leaf: int = 1 << 16, group_cap: int = 1 << 20) -> DataFrame:
    """Distinct ``fp`` -> ``(u, v)``: edges whose components are those of all links within ``budget`` bits."""
    within = [(BITS, budget)]
    dealt = trie_groups(prints.select(F.lit(0).alias("face"), "fp"), within, 1, leaf, group_cap)

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, every, mine = sorted_group(group)
        label = np.arange(len(every))
        for p, q in linked_pairs(every[mine], every, within, int(key[0])):
            label = forest(label, mine[p], q)
        tied = np.flatnonzero(label != np.arange(len(every)))
        signed = every.view(np.int64)
        return pd.DataFrame({"u": signed[tied], "v": signed[label[tied]]})

    return dealt.groupBy(*GROUP).applyInPandas(walk, "u bigint, v bigint")


def sorted_group(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a group's prints, the prints in that order, and the places of its node's own ones."""
    every = group["fp"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(every, kind="stable")
    return order, every[order], np.flatnonzero(group["own"].to_numpy(bool)[order])


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """``(doc_id, text)`` -> one row per input row: ``(doc_id, fingerprint, component_id)``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest doc_id reachable over links of ``budget`` bits or fewer.
    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated rows stay.
    A null doc_id takes part but is nobody's component_id unless its whole component has no id. An empty table gives none.
    """
    rows = materialize(fingerprints(docs, shingle), "prints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = connected_components(trie_links(classes.select("fp"), budget))
    tied = labels.select(F.col("node").alias("fp"), "label")
    placed = classes.join(tied, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = materialize(placed.join(least, "label").select("fp", "component_id"), "of_class")
    release(classes)
    out = rows.join(of_class, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
