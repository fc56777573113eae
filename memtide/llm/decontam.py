"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, hashes of ``min_match`` consecutive tokens. Of an item, seeds
that very many documents hold are left out of the join as long as all that they cover could not make a finding; every
finding then shares a seed of those that remain. Pairs that meet are tiled: the longest common run of unmarked tokens is
found by running Karp-Rabin, marked in both and never used again, then the next longest, down to ``min_match``. The share
of an item's tokens under tiles tells contamination, in whatever order its parts occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.llm.rows import by_size, text_key, without
from memtide.llm.scratch import materialize
from memtide.llm.workers import frugal

#: Blocks of scripts that are written without blanks; each of their characters is a token.
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
tokens_of = re.compile(rf"(?=\w)[{_ALONE}]|[^\W{_ALONE}]+").findall
#: A token that equals none; it stands in a document's line for tokens that no seed covers.
GAP = np.uint64(0)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Rows of a table that is sent to every task; larger ones are shuffled.
MAX_SENT = 2_000_000


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the tokens: runs of word characters, lower-cased, and single characters of scripts without blanks."""
    tokens = tokens_of((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)) | np.uint64(1)


def seed_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive tokens."""
    n = max(0, len(ids) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out + ids[i : i + n]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return out


class _Line:
    """Tokens with marks, and the Karp-Rabin hashes of their windows from running sums."""

    def __init__(self, tokens: np.ndarray, used: np.ndarray) -> None:
        self.tokens, self.used = tokens, used
        power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(tokens), x, np.uint64)]), dtype=np.uint64)
        self.up = power(_BASE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power(_BACK)[:-1], dtype=np.uint64)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, hashes)`` of the windows without a marked token."""
        marks = np.concatenate([[0], np.cumsum(self.used)])
        starts = np.flatnonzero(marks[size:] == marks[:-size])
        return starts, (self.sums[starts + size] - self.sums[starts]) * self.up[starts]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int = 5) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item start, doc start, length)``: longest first, then leftmost in the item, then in the document.

    The longest size is found by bisection; all tiles of a size are placed in one walk, where each class of equal windows
    moves through the document's once. There are at most about the root of twice the item's length sizes.
    """
    a, b = _Line(item, np.zeros(len(item), bool)), _Line(doc, doc == GAP)
    tiles: list[tuple[int, int, int]] = []
    high = min(len(item), len(doc))
    while high >= min_match:
        low, top = min_match - 1, high
        while low < top:  # a common window of a size holds one of every smaller size
            size = (low + top + 1) // 2
            low, top = (size, top) if np.isin(a.windows(size)[1], b.windows(size)[1]).any() else (low, size - 1)
        if low < min_match:
            break
        (pa_, ha), (pb, hb) = a.windows(low), b.windows(low)
        order = np.argsort(hb, kind="stable")
        ranked, places = hb[order], pb[order]
        first, last = np.searchsorted(ranked, ha, "left"), np.searchsorted(ranked, ha, "right")
        met = np.flatnonzero(last > first)
        moved: dict[int, int] = {}
        free = 0
        for p, lo, hi in zip(pa_[met].tolist(), first[met].tolist(), last[met].tolist(), strict=True):
            if p < free:
                continue
            at = moved.get(lo, lo)
            while at < hi and (b.used[q := int(places[at])] or b.used[q + low - 1]):
                at += 1
            moved[lo] = at
            if at < hi and (item[p : p + low] == doc[q : q + low]).all():
                a.used[p : p + low] = b.used[q : q + low] = True
                tiles.append((p, q, low))
                free = p + low
        high = low - 1
    return tiles


class Filter:
    """Which of many hashes are among the benchmark's: a bit table first, then a sorted array."""

    def __init__(self, seeds: np.ndarray) -> None:
        self.seeds = np.sort(seeds)
        self.low = np.uint64((1 << min(27, max(16, len(seeds).bit_length() + 4))) - 1)
        self.maybe = np.zeros(int(self.low) + 1, bool)
        self.maybe[self.seeds & self.low] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        found = np.flatnonzero(self.maybe[hashes & self.low])
        at = np.minimum(np.searchsorted(self.seeds, hashes[found]), len(self.seeds) - 1)
        return found[self.seeds[at] == hashes[found]]


def shared_lines(texts: list[str | None], sizes: list[int], known: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(place, seeds, line)`` of the texts that hold a seed of the benchmark; without a filter, of all texts with a seed.

    ``line`` has the tokens under such seeds, all that a tile can hold; a GAP stands for what lies between.
    """
    parts = [token_hashes(t) for t in texts]
    ids = np.concatenate([*parts, np.zeros(0, np.uint64)])
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    spots, sizes_at, values = [], [], []
    for size in sizes:
        hashes = seed_hashes(ids, size)
        found = known.hits(hashes) if known else np.arange(len(hashes))
        found = found[found + size <= ends[np.searchsorted(ends, found, "right")]] if len(found) else found
        spots.append(found), sizes_at.append(np.full(len(found), size)), values.append(hashes[found])
    spot, size, value = map(np.concatenate, (spots, sizes_at, values))
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, spot, 1)
    np.add.at(edge, spot + size, -1)
    under = np.cumsum(edge)[:-1] > 0
    whose = np.searchsorted(ends, spot, "right")
    order = np.argsort(whose, kind="stable")
    edges = np.flatnonzero(np.diff(whose[order], prepend=-1, append=len(parts)))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        place = int(whose[order[lo]])
        begin, end = int(ends[place]) - len(parts[place]), int(ends[place])
        kept = np.flatnonzero(under[begin:end])
        line = np.insert(parts[place][kept], np.flatnonzero(np.diff(kept) > 1) + 1, GAP)
        yield place, np.unique(value[order[lo:hi]]), line


def _items(benchmark: DataFrame, min_match: int) -> DataFrame:
    """``(irow, item_id, tokens, seeds)``, a row for each benchmark row with a token."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [token_hashes(t) for t in batch.column(2).to_pylist()]
            seeds = [seed_hashes(t, min(min_match, len(t))) if len(t) else t for t in tokens]
            full = pa.array([len(t) > 0 for t in tokens])
            signed = lambda rows: pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), signed(tokens), signed(seeds)]
            yield pa.RecordBatch.from_arrays([c.filter(full) for c in columns], names=["irow", "item_id", "tokens", "seeds"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("irow"), F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "irow bigint, item_id bigint, tokens array<bigint>, seeds array<bigint>"), "items", "none")


def _lines(docs: DataFrame, sizes: list[int], known: Filter | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = list(shared_lines(part.column(3).to_pylist(), sizes, sent.value))
                take = pa.array([i for i, _, _ in found], pa.int64())
                signed = lambda rows: pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), signed([s for _, s, _ in found]), signed([x for _, _, x in found])], names=["row", "doc_id", "t", "seeds", "line"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("t"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "row bigint, doc_id bigint, t bigint, seeds array<bigint>, line array<bigint>"), "lines", "none")


def _joined_seeds(items: DataFrame, lines: DataFrame, min_match: int, min_coverage: float) -> DataFrame:
    """``(seed, irow)``: the seeds on which an item is joined. Those left out, the most frequent ones, cover too little."""
    held = lines.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    rows = items.select("irow", F.size("tokens").alias("length"), F.posexplode("seeds").alias("pos", "seed")).join(held, "seed")

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        length = int(group["length"].iloc[0])
        size, most = min(min_match, length), np.ceil(min_coverage * length) - 1
        under, out = np.zeros(length, bool), []
        places = group.groupby("seed")["pos"].apply(np.array)
        for seed in group.drop_duplicates("seed").sort_values(["n", "seed"], ascending=[False, True])["seed"]:
            more = under.copy()
            for p in places[seed]:
                more[p : p + size] = True
            if more.sum() <= most:
                under = more
            else:
                out.append(seed)
        return pd.DataFrame({"seed": np.array(out, np.int64), "irow": np.full(len(out), key[0], np.int64)})

    return rows.groupBy("irow").applyInPandas(choose, "seed bigint, irow bigint")


def _pairs(docs: DataFrame, benchmark: DataFrame, min_match: int, min_coverage: float) -> DataFrame:
    items = _items(benchmark, min_match)
    sizes = sorted(r["s"] for r in items.select(F.least(F.lit(min_match), F.size("tokens")).alias("s")).distinct().collect())  # at most min_match
    seeds = items.select(F.explode("seeds").alias("seed")).distinct()
    # The filter only spares the shuffle of seeds that no item has; a benchmark too large for it does without.
    few = seeds.limit(8 * MAX_SENT + 1).count() <= 8 * MAX_SENT
    known = Filter(seeds.toPandas()["seed"].to_numpy(np.int64).view(np.uint64)) if few and sizes else None
    lines = _lines(docs if sizes else docs.limit(0), sizes or [min_match], known)
    joined = materialize(_joined_seeds(items, lines, min_match, min_coverage), "seeds", "none")
    meets = lines.select("row", F.explode("seeds").alias("seed")).join(by_size(joined, MAX_SENT), "seed").select("row", "irow").distinct()
    told = items.select("irow", "item_id", "tokens")
    sent = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    pairs = meets.join(lines.select("row", "doc_id", "t", "line"), "row").join(F.broadcast(told) if sent <= MAX_SENT else told, "irow")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t, item_id, tokens, line in zip(*(c.to_pylist() for c in batch.columns[:3]), *(batch.columns[3:]), strict=True):
                item, doc = (x.values.to_numpy().view(np.uint64) for x in (tokens, line))
                size = min(min_match, len(item))
                if np.isin(item, doc).sum() < min_coverage * len(item):
                    continue
                tiles = tile(item, doc, size)
                matched = sum(n for _, _, n in tiles)
                if matched >= min_coverage * len(item):
                    rows.append((doc_id, t, item_id, len(tiles), matched, len(item), matched / len(item)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "t", "item_id", "n_tiles", "matched_tokens", "item_tokens", "coverage"])

    # Few bytes and much work: dealt out by rows, not by size.
    pairs = pairs.select("doc_id", "t", "item_id", "tokens", "line").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.mapInArrow(run, "doc_id bigint, t bigint, item_id bigint, n_tiles int, matched_tokens int, item_tokens int, coverage double")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.5) -> DataFrame:
    """Documents and items that overlap: ``(doc_id, item_id, n_tiles, matched_tokens, item_tokens, coverage)``.

    Tokens are runs of word characters, lower-cased; in scripts without blanks every character is one. A pair is returned
    when tiles of ``min_match`` tokens or more cover ``min_coverage`` of the item. An item of fewer tokens is found where
    all of it occurs as it stands. Items without a token are in no document; null texts are empty; repeated rows are
    returned as often; null ids stay null; extra columns are ignored; an empty table on either side gives none.
    """
    return _pairs(docs, benchmark, min_match, min_coverage).drop("t")


def reject(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found. Verdicts are by row: ids may be null or repeat."""
    found = materialize(_pairs(docs, benchmark, min_match, min_coverage).select("doc_id", "t").distinct(), "found")
    return without(docs, found)
