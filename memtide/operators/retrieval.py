"""Scorers, fusion and the ranking steps of recall. Scores are rows ``(query_id, pos, score)``; no row, no score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memtide.functions.text import tokenize
from memtide.functions.vec import cosine
from memtide.operators import lists, postings
from memtide.operators.matrix import matrix_ends, matrix_keys, matrix_places, matrix_scores, matrix_top
from memtide.plans.lineage import cut, settled, uncut


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def vector_scores(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Cosine of every query with every memory, as products of matrices; the queries go to the memories' tasks in blocks."""
    return matrix_scores(queries, memories)


def vector_top(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """The ``k`` memories with the largest cosine of every query; each batch of memories sends on ``k`` a query at most."""
    return truncate(matrix_top(queries, memories, k), k)


def bm25_scores(queries: DataFrame, memories: DataFrame, k1: float = 1.5, b: float = 0.75, idf_floor: float = 0.25, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """BM25 of ``queries(query_id, text)`` over ``memories(pos, text)``; rows that score nothing are left out.

    A term that a query repeats counts as often; ``tokenizer`` makes an array of a text column. See :mod:`.postings`.
    """
    index = postings.build_index(memories, k1, b, idf_floor, tokenizer)
    found = postings.scores(postings.ask(queries, index))
    uncut(index.lists)  # what is asked of them is packed
    return found.select("query_id", "pos", (F.col("n") / postings.UNIT).alias("score"))


def bm25_top(queries: DataFrame, memories: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, idf_floor: float = 0.25, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """``(query_id, pos, score, rank)``: the ``k`` best of :func:`bm25_scores`, the others left out below a bound."""

    def found() -> DataFrame:
        asked = postings.ask(queries, postings.build_index(memories, k1, b, idf_floor, tokenizer))
        return postings.top(asked, k).select("query_id", "pos", (F.col("n") / postings.UNIT).alias("score"), "rank")

    return settled(found)


def rank(scores: DataFrame, *extra: str) -> DataFrame:
    """1-based ranks, score descending, ties by position. Scores that agree to nine places tie, whatever the order of sums."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *extra).orderBy(F.round("score", 9).desc(), "pos")))


def rank_by_ranges(scores: DataFrame, partitions: int) -> DataFrame:
    """:func:`rank` for rankings too long for one task: rows are dealt by range over query, score and position.

    A row's rank is its place in its range plus the counts of the query's ranges before, of which there are few.
    """
    keys = ["query_id", F.round("score", 9).desc(), "pos"]
    dealt = cut(scores.repartitionByRange(partitions, *keys).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("query_id", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("query_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*keys[1:]))
    return dealt.withColumn("_place", place).join(before, ["query_id", "_part"]).select(*scores.columns, (F.col("_before") + F.col("_place")).alias("rank"))


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], k: int = 60, partitions: int | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the rankings; a union and one aggregation stand for the outer join.

    Without ``partitions`` a query's ranking is one sort; with it the ranking is dealt over so many tasks.
    """
    place = (lambda r: rank_by_ranges(r, partitions)) if partitions else rank
    parts = [place(r.select("query_id", "pos", "score")) for r in rankings]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "pos").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def rank_fusion(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """:func:`reciprocal_rank_fusion` of cosine and BM25 for ``queries(query_id, text, embedding)``: ``(query_id, pos, score)``.

    Up to ``lists.MOST`` memories a query's scores are ranked as arrays in one task; of more the rows are ranked by ranges.
    """
    queries, memories = cut(queries.select("query_id", "text", "embedding")), cut(memories.select("pos", "text", "embedding"))
    if (n := memories.count()) > lists.MOST:
        partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return reciprocal_rank_fusion([vector_scores(queries, memories), bm25_scores(queries, memories)], partitions=partitions)
    index = postings.build_index(memories)
    found = lists.fused(queries, memories, n, postings.ask(queries, index), lists.every_sum, "pos bigint, score double")
    uncut(index.lists)  # what is asked of them is packed
    return found


def min_max(column: str, by: str = "query_id", flat: str = "one") -> Column:
    """Scaled to [0, 1] within a query. Equal values become 1, or with ``flat='sign'`` 0 unless they are positive."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    same = F.lit(1.0) if flat == "one" else F.when(high > 0, 1.0).otherwise(0.0)
    return F.when(high == low, same).otherwise((F.col(column) - low) / (high - low))


def normalized(scores: DataFrame) -> DataFrame:
    """``score`` scaled to [0, 1] within its query, equal scores to 1. Bounds are aggregated and sent back, so no task
    gathers a query's rows."""
    bounds = scores.groupBy("query_id").agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    scaled = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise((F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return scores.join(bounds, "query_id").select("query_id", "pos", scaled.alias("score"))


def weighted_fusion(rankings: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    if len(rankings) != len(weights):
        raise ValueError("as many weights as rankings are needed")
    whole = None
    for ranking, weight in zip(rankings, weights, strict=True):
        part = normalized(ranking).select("query_id", "pos", (F.col("score") * weight).alias("score"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("query_id", "pos").agg(F.sum("score").alias("score"))


def weighted_search(queries: DataFrame, memories: DataFrame, vector: float, terms: float) -> DataFrame:
    """:func:`weighted_fusion` of cosine and BM25 for ``queries(query_id, text, embedding)``, without a shuffle of scores."""
    queries, memories = cut(queries.select("query_id", "text", "embedding")), cut(memories.select("pos", "text", "embedding"))
    return lists.weighted(queries, memories, postings.ask(queries, postings.build_index(memories)), (vector, terms))


@dataclass(frozen=True)
class RecallConfig:
    top_k: int = 5
    min_score: float = 0.0
    candidates: int = 50
    similarity: float = 0.9
    lifecycle_weight: float = 0.3
    additive: bool = False


def combined(retrieval: Column, lifecycle: Column, c: RecallConfig) -> Column:
    w = c.lifecycle_weight
    return (1 - w) * retrieval + w * lifecycle if c.additive else retrieval * (1 + w * lifecycle)


def truncate(scored: DataFrame, k: int, *order: Column | str, keep: str | None = None) -> DataFrame:
    """The first ``k`` rows of each query; Spark cuts within tasks before it shuffles. ``keep`` names the place from 1."""
    w = Window.partitionBy("query_id").orderBy(*(order or (F.round("score", 9).desc(), "pos")))
    few = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return few.withColumnRenamed("_n", keep) if keep else few.drop("_n")


def representatives(rows: Column, threshold: float) -> Column:
    """Greedy clustering of an ordered array of structs with ``embedding``: those unlike every one kept before."""
    if threshold >= 1.0:
        return rows
    empty = F.slice(rows, 1, 0)
    return F.aggregate(rows, empty, lambda kept, x: F.when(F.exists(kept, lambda r: cosine(r["embedding"], x["embedding"], "zero") >= threshold), kept).otherwise(F.concat(kept, F.array(x))))


def semantic_dedup(scored: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``(query_id, pos, score, embedding)`` -> the representatives, best first. For a bounded number of rows a query."""
    rows = F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("key"), "pos", (-F.col("score")).alias("exact"), "embedding")))
    return scored.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.inline(representatives(F.col("r"), threshold))).select("query_id", "pos", (-F.col("exact")).alias("score"))


Scorer = Callable[[DataFrame, DataFrame], DataFrame]
Fusion = Callable[[Sequence[DataFrame]], DataFrame]


class Ranking(Protocol):
    """A ranking of rows for each query that is not written out: its ends, and the places of given rows."""

    def ends(self, first: int, last: int, also: DataFrame | None = None) -> DataFrame:
        """``(query_id, pos, key, front, back, length, absent)``: the first and last rows with their places from either end,
        null beyond it, and the keys of those of ``also(query_id, pos)`` that are ranked. ``length`` and ``absent`` are how
        many rows are ranked and how many not; rows that are not, key null, are there too if they are ``last`` at most."""

    def keys(self, pairs: DataFrame, most: int) -> DataFrame:
        """``(query_id, pos, key)`` of those of ``pairs(query_id, pos)`` that are ranked, at most ``most`` a query."""

    def places(self, keyed: DataFrame, most: int) -> DataFrame:
        """``(query_id, pos, rank)`` of ``(query_id, pos, key)``, at most ``most`` a query."""

    def within(self, some: DataFrame) -> Ranking:
        """The same for the queries ``some(query_id)`` alone."""


class VectorRanking:
    """By cosine, ties by position; every row with a vector of the query's length is ranked."""

    def __init__(self, queries: DataFrame, memories: DataFrame) -> None:
        self.queries, self.rows = queries.select("query_id", "embedding"), memories.select("pos", "embedding")

    def ends(self, first: int, last: int, also: DataFrame | None = None) -> DataFrame:
        found = cut(matrix_ends(self.queries, self.rows, first, last))
        order = [F.col("score").desc(), F.col("pos").asc()]
        place = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
        front = found.withColumn("front", place(*order)).where(F.col("front") <= first).drop("score")
        back = found.withColumn("back", place(F.col("score").asc(), F.col("pos").desc())).where(F.col("back") <= last).drop("score")
        sizes = self.rows.groupBy(F.size("embedding").alias("_d")).agg(F.count("embedding").alias("length"))
        lengths = self.queries.select("query_id", F.size("embedding").alias("_d")).join(F.broadcast(sizes), "_d").select("query_id", "length")
        numbered = found.distinct().join(front, ["query_id", "pos"], "left").join(back, ["query_id", "pos"], "left").where("front is not null or back is not null")
        return numbered.join(lengths, "query_id").select("query_id", "pos", F.col("score").alias("key"), "front", "back", "length", F.lit(None).cast("bigint").alias("absent"))

    def keys(self, pairs: DataFrame, most: int) -> DataFrame:
        return matrix_keys(self.queries, self.rows, pairs, most).withColumnRenamed("score", "key")

    def places(self, keyed: DataFrame, most: int) -> DataFrame:
        return matrix_places(self.queries, self.rows, keyed.withColumnRenamed("key", "score"), most)

    def within(self, some: DataFrame) -> VectorRanking:
        return VectorRanking(self.queries.join(some, "query_id", "left_semi"), self.rows)


class TermRanking:
    """By BM25 over an index; rows without a term of the query are not ranked."""

    def __init__(self, asked: postings.Asked) -> None:
        self.asked = asked

    def ends(self, first: int, last: int, also: DataFrame | None = None) -> DataFrame:
        return postings.ends(self.asked, first, last, also).withColumn("n", F.when(F.col("n") > 0, F.col("n"))).withColumnRenamed("n", "key")

    def keys(self, pairs: DataFrame, most: int) -> DataFrame:
        return self.ends(0, 0, pairs).select("query_id", "pos", "key")

    def places(self, keyed: DataFrame, most: int) -> DataFrame:
        return postings.places(self.asked, keyed.withColumnRenamed("key", "n"))

    def within(self, some: DataFrame) -> TermRanking:
        return TermRanking(replace(self.asked, told=self.asked.told.join(some, "query_id", "left_semi"), weighed=self.asked.weighed.join(some, "query_id", "left_semi")))


#: Rows that are read at the end of a ranking, at least.
LEAST_ENDS = 64


def fused_ends(rankings: Sequence[Ranking], total: int, k: int, c: int = 60) -> DataFrame:
    """``(query_id, pos, score, low, high)``: rows among which are the ``k`` best of each query by the sum of 1 / (c + rank),
    and the least and largest sum that any ranked row has; of ``total`` rows. Sums are exact, though no ranking is written.

    *Best.* The first P = m * (c + k) - c rows of each of m rankings are read. A row in none of these has m / (c + P + 1) at
    most, which is less than 1 / (c + k), and that much the ``k`` first rows of any ranking have. So one reading is enough.

    *Least.* The last rows of each ranking are read, at first twice the root of ``total``: that many stand at random places
    of the other ranking, one of them near its end. A row in none of these ends is ranked before, so a ranking of n rows
    that has it adds 1 / (c + n - last) at least; a ranking of all rows, or one whose absent rows are all known, surely has
    it. Queries whose least sum so far is above that are asked again, with ends eight times as long.

    What is read at an end of one ranking is asked for in the others.
    """
    first, last, done = len(rankings) * (c + k) - c, max(LEAST_ENDS, int(2 * total**0.5)), []
    while True:
        most, seen, ends, parts = 2 * len(rankings) * (first + last), None, [], []
        for ranking in rankings:
            ends.append(cut(ranking.ends(first, last, seen)))
            seen = ends[-1].select("query_id", "pos") if seen is None else seen.union(ends[-1].select("query_id", "pos")).distinct()
        for i, (ranking, told) in enumerate(zip(rankings, ends, strict=True)):
            placed = F.col("front").isNotNull() | F.col("back").isNotNull()
            keyed = told.where(F.col("key").isNotNull() & ~placed).select("query_id", "pos", "key")
            if i + 1 < len(rankings):  # the last one was asked for all that the others found
                keyed = cut(keyed.union(ranking.keys(seen.join(told, ["query_id", "pos"], "left_anti"), most).select("query_id", "pos", "key")))
            known = told.where(placed).select("query_id", "pos", F.coalesce("front", F.col("length") - F.col("back") + 1).alias("rank"))
            parts += [known, ranking.places(keyed, most).select("query_id", "pos", "rank")]
        sums = cut(_union(parts).groupBy("query_id", "pos").agg(F.sum(F.lit(1.0) / (c + F.col("rank"))).alias("score")))
        left = F.when(F.col("length") > first + last, 1.0 / (c + F.col("length") - last)).otherwise(F.lit(float("inf")))
        sure = (F.col("length") == total) | (F.col("absent") <= last)
        each = _union([e.groupBy("query_id").agg(F.max("length").alias("length"), F.max("absent").alias("absent")) for e in ends]).withColumns({"left": left, "sure": sure})
        bounds = each.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("sure"), F.col("left"))), F.min("left")).alias("bound"))
        span = cut(sums.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high")).join(bounds, "query_id"))
        ok = F.col("low") <= F.col("bound") if last < total else F.lit(True)
        done.append(sums.join(span.where(ok).drop("bound"), "query_id"))
        open_ = span.where(~ok).select("query_id")
        if last >= total or open_.isEmpty():
            return _union(done)
        rankings, last = [r.within(open_) for r in rankings], last * 8


def recall(queries: DataFrame, memories: DataFrame, lifecycle: Column | None, config: RecallConfig = RecallConfig(), scorers: Sequence[Scorer] | None = None, fuse: Fusion | None = None, use_terms: bool = True) -> DataFrame:
    """Hybrid recall of ``queries(query_id, text, embedding)`` over ``memories(pos, text, embedding, ...)``.

    ``lifecycle`` is a score over columns of ``memories``; without one the fused score is the score. ``use_terms=False``
    leaves BM25 out. Returns ``(query_id, rank, pos, score)``, written. By default
    cosine and BM25 are fused by reciprocal ranks: of up to ``lists.MOST`` memories each ranking is sorted as an array, of
    more only the ends of either ranking are read (:func:`fused_ends`).
    Otherwise any function of queries and memories that returns ``(query_id, pos, score)`` is a
    scorer, any of rankings a fusion, and every score is ranked.
    """
    return settled(lambda: _recall(queries, memories, lifecycle, config, scorers, fuse, use_terms))


def _recall(queries: DataFrame, memories: DataFrame, lifecycle: Column | None, config: RecallConfig, scorers: Sequence[Scorer] | None, fuse: Fusion | None, use_terms: bool) -> DataFrame:
    queries, memories = cut(queries.select("query_id", "text", "embedding")), cut(memories.withColumn("_life", F.lit(0.0) if lifecycle is None else lifecycle).select("pos", "text", "embedding", "_life"))
    if scorers is None and fuse is None:
        n, asked = memories.count(), postings.ask(queries, postings.build_index(memories)) if use_terms else None
        if n <= lists.MOST:
            ends = lists.fused(queries, memories, n, asked, lists.ends_of(config.candidates), "pos bigint, score double, low double, high double", pairs=lists.PAIRS)
        else:
            ends = fused_ends([VectorRanking(queries, memories), *([TermRanking(asked)] if asked else [])], n, config.candidates)
        scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
        fused = ends.select("query_id", "pos", scaled.alias("score"))
    else:
        fused = normalized((fuse or reciprocal_rank_fusion)([score(queries, memories) for score in scorers or (vector_scores, bm25_scores)]))
    few = truncate(fused.where(F.col("score") >= config.min_score), config.candidates)
    few = few.join(memories.select("pos", "embedding", F.col("_life").alias("life")), "pos")
    if lifecycle is not None:
        few = few.withColumn("life", min_max("life", flat="sign"))
        few = few.withColumn("score", combined(F.col("score"), F.col("life"), config))
    few = few.select("query_id", "pos", "embedding", "score")
    kept = semantic_dedup(few, config.similarity)
    return truncate(rank(kept), config.top_k).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


def pairwise_similarity(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine of two different rows of a group, from sums: |sum of unit vectors|^2 = n + sum over pairs."""
    unit = vectors.select(by, F.posexplode("embedding").alias("d", "x"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("len"))
    sums = unit.groupBy(by, "d").agg(F.sum(F.when(F.col("len") > 0, F.col("x") / F.col("len")).otherwise(0.0)).alias("s"))
    total = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    n = vectors.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0, 1).otherwise(0)).alias("live"))
    return total.join(n, by).select(by, "n", F.when(F.col("n") > 1, (F.col("t") - F.col("live")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("mean_similarity"))
