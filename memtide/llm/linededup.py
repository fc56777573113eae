"""Line deduplication on DataFrame operations alone.

Hashes of the long lines are dealt by range and sorted by hash, document (descending) and position. The sorted run of one
hash is streamed once by a window: its first document keeps its lines, and when the run holds enough documents the later
ones lose theirs. A line that a large share of all rows holds is cut, by ranges of documents, into several runs; only
such runs are tied together afterwards, from one row a run. The result is a compressed bitmap per document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize

#: The six ASCII white-space characters of \x20\x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z, and no other letter, in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, text, ...)`` -> ``(h, g, doc_id, t, pos, ...)`` for every line whose key has ``min_chars`` code points.

    ``h`` and ``g`` are two 64-bit hashes with different seeds: 128 bits tell keys apart at any corpus size. ``t`` is a
    hash of the text; with the id it names a row, so rows that share an id and differ in text stay apart.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), *more, F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "doc_id", "t", "pos", *more)


def _placed(docs: DataFrame, steps: int) -> DataFrame:
    """``place``: in which of ``steps`` ranges of about as many documents an id lies, the largest ids first."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 10_000).alias("c")).first()["c"] or []
    at = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    return docs.withColumn("place", at)


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, t, dropped)`` for the rows that lose lines; ``t`` is a hash of the text.

    ``dropped`` is the complement of the keep bitmap, as a sorted array of ``(word, bits)``: bit i of ``word`` stands for
    line ``64 * word + i``. Words without a dropped line are left out, and so are documents that keep every line.
    """
    spark = docs.sparkSession
    shuffles, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    steps = min(4096, max(2, 2 * shuffles, 2 * (partitions or 0)))
    rows = materialize(line_hashes(_placed(docs.where("doc_id is not null").select("doc_id", "text"), steps), min_chars), "lines", "none", few=True)
    total = rows.count()
    # At least 200 thousand lines a partition where there are fewer than the session's partitions, at most four million.
    n = partitions or max(min(shuffles, max(cores, total // 200_000)), total // 4_000_000, 1)
    # Keys that hold over a quarter of a share, by a sample that sees every share 256 times. The sample decides only how
    # finely a run is cut, never what is dropped. There are at most about four times as many such keys as shares.
    shares = max(n, shuffles)
    rate = max(1, total // (256 * shares))
    seen = rows.where(F.pmod(F.xxhash64("doc_id", "pos", "h"), F.lit(rate)) == 0).groupBy("h", "g").agg(F.count("*").alias("c"))
    hot = seen.where(F.col("c") * rate * 4 * shares > total).select("h", "g", F.least(F.lit(steps), F.ceil(F.col("c") * rate * 4 * shares / total)).cast("int").alias("cut"))
    rows = rows.join(F.broadcast(hot), ["h", "g"], "left").withColumn("part", F.coalesce(F.expr(f"place * cut div {steps}"), F.lit(0)).cast("int"))
    # The windows read the range partitions as they are: no further exchange.
    dealt = rows.repartitionByRange(n, "h", "g", "part")
    run = Window.partitionBy("h", "g", "part").orderBy(F.col("doc_id").desc(), "t", "pos")
    dealt = dealt.withColumn("new", F.when(F.lag("doc_id").over(run) == F.col("doc_id"), 0).otherwise(1))
    dealt = dealt.withColumns({"rank": F.sum("new").over(run), "docs": F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    found = dealt.where(F.col("cut").isNotNull() | ((F.col("docs") >= min_docs) & (F.col("rank") > 1)))
    found = materialize(found.select("h", "g", "part", "docs", F.col("cut").isNotNull().alias("hot"), "doc_id", "t", "pos"), "found", "none")
    # A document lies in one range of documents, so the runs of a cut key share none: one row a key, as few as ``hot``.
    runs = found.where("hot").groupBy("h", "g", "part").agg(F.max("docs").alias("docs"), F.max("doc_id").alias("first"))
    whole = runs.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.max("first").alias("keeper")).where(F.col("docs") >= min_docs)
    lost = found.where("not hot").select("doc_id", "t", "pos")
    lost = lost.unionByName(found.where("hot").join(F.broadcast(whole.drop("docs")), ["h", "g"]).where("doc_id <> keeper").select("doc_id", "t", "pos"))
    words = lost.repartition("doc_id", "t").groupBy("doc_id", "t", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows of ``docs`` as ``(row, kept_text, n_lines, n_dropped)``; ``row`` is a struct of all their columns.

    A null text counts as one empty line.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("_t"))
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("t").alias("_text"), "dropped")
    marked = rows.join(marks.hint("shuffle_hash"), (F.col("row.doc_id") == F.col("_id")) & (F.col("_t") == F.col("_text")), "left")
    text = F.coalesce("row.text", F.lit(""))
    marked = marked.withColumn("dense", F.when(F.col("dropped").isNotNull(), F.expr("transform(sequence(0, array_max(dropped.word)), w -> coalesce(element_at(map_from_entries(dropped), w), 0L))")))
    kept = F.filter(lines_of(F.col("row.text")), lambda line, i: F.coalesce(F.get("dense", F.call_function("shiftright", i, F.lit(6))), F.lit(0).cast("bigint")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 64)) == 0)
    n_dropped = F.coalesce(F.aggregate("dropped", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w["bits"])), F.lit(0).cast("bigint"))
    n_lines = F.length(F.regexp_replace(text, "[^\n]+", "")).cast("bigint") + 1
    return marked.select("row", F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def without_repeats(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row ``(row, kept_text, n_lines, n_dropped)`` per input row; ``row`` holds all of its columns, whatever their names.

    A line's key is the line without ASCII white space at its ends and with A-Z lowered. Keys of ``min_chars`` code
    points or more that ``min_docs`` documents or more hold lose all their lines but those of the largest doc_id.
    Null and empty texts are one empty line. Rows that share a doc_id are one document where documents are counted, and
    each of them loses its own lines. Rows without doc_id keep their lines and are nobody's copy. No rows give none.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """As :func:`without_repeats`, with the columns of ``docs`` side by side.

    The three result columns take the place of columns of ``docs`` with their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    return without_repeats(docs, min_chars, min_docs).select(*(F.col(f"row.`{c}`") for c in kept), "kept_text", "n_lines", "n_dropped")


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
d as (
  select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (
  select k.doc_id, k.pos, k.line, d.keeper is not null and k.doc_id <> d.keeper as gone from k left join d on k.key = d.key)
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
