"""Best-fit packing of tokenised documents into fixed-size sequences, as bulk-synchronous supersteps.

Lengths and gaps are whole numbers up to the capacity, so documents of one length, and sequences with one gap, are
interchangeable. A superstep takes the next longest class of documents, sweeps the gap classes for its successor (the
smallest gap that holds the length), lets the document of rank r take the r-th place, updates the gap classes and
repeats; places are left to the classes below, and what finds none opens sequences. The sweep's input and output are
class tables, bounded by the capacity and not by the rows. Ranks come from a distributed range sort by length: a row's
rank is its place in its range partition plus the counts of the partitions before, so that a length that a third of all
rows share is spread over many tasks. The result equals best-fit decreasing over single documents.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from memtide.llm.scratch import materialize, release
from memtide.llm.workers import frugal

#: Where both tokenizer libraries are known to split alike; any other text takes the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*").fullmatch
_SPECIAL = "<|endoftext|>"


class ByteBpe:
    """Ids of the byte-level BPE in ``json_path``; ``ranks_path`` is the same vocabulary in the faster library's form."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(json_path)
        self._fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None and _PLAIN(text) and _SPECIAL not in text:
            return self._fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """``(doc_id, text)`` -> one row per piece: ``(doc_id, piece, start, length, ids_crc32[, ids])``.

    A document is its ids and then id 0; a null text is empty and so has one id. Documents of more than ``capacity`` ids
    are cut so that every piece but the first is full.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(json_path, ranks_path, pattern)
        for batch in batches:
            keys, whose, piece, start, length, crc, chunks = batch.column(0), [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    end = at + ((len(ids) - 1) % capacity + 1 if k == 0 else capacity)
                    whose.append(i), piece.append(k), start.append(at), length.append(end - at), crc.append(zlib.crc32(ids[at:end].tobytes()))
                    if with_ids:
                        chunks.append(ids[at:end].astype(np.int32))
                    at = end
            columns = [keys.take(pa.array(whose, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(chunks, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan_bound(capacity: int) -> int:
    return 3 * capacity * (1 + capacity.bit_length())


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Class counts -> ``(length, first rank, end rank, first sequence, per sequence, offset)``.

    The document of ``length`` and rank r in [first, end) goes to sequence ``first sequence + (r - first) // per``,
    at ``offset + (r - first) % per * length``. The plan has at most ``plan_bound(capacity)`` rows, whatever the counts: a
    length makes at most three runs of gaps more than it uses up, and each use leaves less than half of a gap.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs of (first sequence, count)
    placed, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, end, gap = 0, counts[length], length
        while rank < end:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap <= capacity:
                first, many = gaps[gap].pop()
                room = gap
            else:
                first, many, room = fresh, -(-(end - rank) // (capacity // length)), capacity
                fresh += many
            per = room // length
            take = min(end - rank, many * per)
            placed.append((length, rank, rank + take, first, per, capacity - room))
            whole, rest = divmod(take, per)
            used = whole + bool(rest)
            for start, n, left in ((first, whole, room - per * length), (first + whole, int(bool(rest)), room - rest * length), (first + used, many - used, room)):
                if n and left:
                    gaps[left].append((start, n))
            rank += take
    return placed


def ranked_by_length(pieces: DataFrame, partitions: int) -> DataFrame:
    """``pieces`` with ``rank``: a row's place, from 0, among the rows of its length."""
    columns = [*pieces.columns, "part"]

    @frugal
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            new = np.concatenate([[lengths[0] != last], lengths[1:] != lengths[:-1]])
            place = np.arange(len(lengths))
            first = np.maximum.accumulate(np.where(new, place, -1))
            local = np.where(first >= 0, place - first, place + seen)
            last, seen = lengths[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local.astype(np.int64))], names=[*columns, "place"])

    keys = [F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32"]
    dealt = pieces.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    rows = materialize(dealt.mapInArrow(number, StructType([*pieces.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())])), "ranked")
    per = rows.groupBy("length", "part").agg(F.count("*").alias("n"))  # a range partition holds few lengths
    before = per.selectExpr("length", "part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before")
    return rows.join(before, ["length", "part"]).withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def pack(pieces: DataFrame, capacity: int = 2048, partitions: int | None = None) -> DataFrame:
    """Pieces with a ``length`` of 1 to ``capacity`` -> the same rows with ``(sequence_id, offset)``.

    In each sequence the offsets run from 0 without a gap. Ties are settled by doc_id, piece and checksum; repeated rows
    are packed as often as they occur; null doc_ids are packed like others; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = best_fit_plan(counts, capacity)
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // 2_000_000)
    ranked = ranked_by_length(pieces, partitions)
    places = spark.createDataFrame(plan, "length bigint, r0 bigint, r1 bigint, s0 bigint, per bigint, o0 bigint")
    # At most plan_bound(capacity) rows, 74 thousand for 2048, however many pieces there are.
    joined = ranked.join(F.broadcast(places), "length").where("rank >= r0 and rank < r1")
    out = joined.selectExpr(*pieces.columns, "s0 + (rank - r0) div per as sequence_id", "o0 + (rank - r0) % per * length as `offset`")
    release(pieces)
    return out


def packed_sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces placed by :func:`pack`, with ``ids`` -> ``(sequence_id, ids, doc_ids)``, at most ``capacity`` ids a row."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
