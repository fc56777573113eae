"""Secret scanning: fixed patterns, and a guess-cost estimate of values in a credential context.

The cost of a value is the least number of guesses, as a power of ten, over all ways to cut it into dictionary words,
dates, repeats, sequences and keyboard walks, and single characters guessed by brute force; a dynamic programme over the
positions finds it. Values that cost much are secrets; ``changeme2024`` and ``qwerty123`` are not. The dictionary is a list
of common passwords, then the words of a public vocabulary, and beside them all words of the documents themselves, by the
number of documents that have them.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memtide.llm.quality_rules import sketch_bin
from memtide.llm.rows import MAX_KEYS, by_size
from memtide.llm.scratch import materialize
from memtide.llm.workers import frugal
from memtide.sources.scan import spread

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?)"
#: A scheme word before the value, unless what follows it is a context of its own.
_SCHEME = rf"""(?:(?:bearer|basic|token)\x20+(?![\w-]*{_NAMES}["']?\x20*[:=]))?"""
#: Credential contexts of the costed values: more names, quoted values of any characters, and unquoted ones up to a blank.
_CONTEXT = re.compile(rf"""(?i:{_NAMES}["']?\x20*(?::=|=>|[:=])\x20*(?:"{_SCHEME}([^"\n]+)"|'{_SCHEME}([^'\n]+)'|{_SCHEME}([^\s"'<>,;]+)))""", re.ASCII)

#: Words that guessers try first, commonest first, and the rows of the usual keyboards.
WORDS = """
password qwerty admin welcome letmein login monkey dragon master secret hello shadow sunshine princess football baseball
iloveyou trustno superman batman michael jordan hunter ranger summer winter spring autumn monday friday pass user root
test guest default change changeme please access server system database example sample demo temp temporary public private
token key api auth client service account value string null none true false undefined your here insert replace todo
company office internet computer network google amazon github love angel flower cheese cookie coffee banana orange
purple silver golden money freedom killer pepper ginger charlie thomas robert daniel jessica ashley nicole george
january february march april june july august september october november december
""".split()
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_LEET = str.maketrans("4@301!|$57+", "aaeoiilsstt")
_NEXT = {(row[i], row[i + 1]) for row in KEYS for i in range(len(row) - 1)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII).fullmatch
#: Longest word of the dictionary, longest block that is told again, longest part of a run that is no whole run.
LONGEST, BLOCK, PART = 24, 16, 64


def ranks_of(words: Iterable[str] = ()) -> dict[str, int]:
    """Ranks from 1: the fixed words and then ``words`` in their order."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}


def _runs(low: str) -> list[tuple[int, int, int]]:
    """``(start, end, base)``: longest runs, three or more, of one character or of steps along a key row, either way."""
    out = []
    for step in (0, 1, -1):
        same = [low[i] == low[i - 1] if step == 0 else (low[i - 1], low[i])[::step] in _NEXT for i in range(1, len(low))]
        start = 0
        for i in range(1, len(low) + 1):
            if i == len(low) or not same[i - 1]:
                if i - start >= 3:
                    out.append((start, i, 40 if step == 0 else 100))
                start = i
    return out


def guess_cost(value: str, ranks: Mapping[str, int] | None = None) -> float:
    """Least log10 of guesses over all segmentations of ``value``; 0 for an empty one.

    Pieces are: a single character; a word of the dictionary (3 to ``LONGEST`` letters, capitals and look-alike characters
    cost extra); a date or a year; a part of a run, of 3 to ``PART`` characters or the whole run; and a block of 2 to
    ``BLOCK`` characters told again, once or more, right after itself. The work grows in proportion to the length.
    """
    ranks = ranks_of() if ranks is None else ranks
    n, low = len(value), value.lower()
    plain = low.translate(_LEET) if len(low) == n else value
    low = low if len(low) == n else value
    runs = _runs(low)
    ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for start, end, base in runs:
        for b in range(start + 3, end + 1):
            ending[b].append((start, base))
    matched = [0] * (BLOCK + 1)  # by width: how many characters up to here equal the one so far back
    best = [0.0] + [math.inf] * n
    for b in range(1, n + 1):
        c = value[b - 1]
        least = best[b - 1] + (1.0 if c.isdigit() else 1.2 if c.islower() else 1.4)
        for start, base in ending[b]:
            for a in range(max(start, b - PART), b - 2):
                least = min(least, best[a] + math.log10(base * (b - a)))
            least = min(least, best[start] + math.log10(base * (b - start)))
        for a in range(max(0, b - 10), b - 3):
            if value[a].isdigit() and c.isdigit() and _DATE(value, a, b):
                least = min(least, best[a] + (2.0 if b - a == 4 else math.log10(36500)))
        for a in range(max(0, b - LONGEST), b - 2):
            rank = ranks.get(plain[a:b])
            if rank:
                bends = (value[a:b] != low[a:b]) + (low[a:b] != plain[a:b])
                least = min(least, best[a] + math.log10(10 * rank) + bends * math.log10(4))
        for width in range(2, min(BLOCK, b - 1) + 1):
            matched[width] = matched[width] + 1 if value[b - 1] == value[b - 1 - width] else 0
            for times in range(1, min(matched[width] // width, PART) + 1):
                least = min(least, best[b - times * width] + math.log10(1 + times))
            if (times := matched[width] // width) > PART:
                least = min(least, best[b - times * width] + math.log10(1 + times))
        best[b] = least
    return best[n]


def word_counts(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``(w, n)``: words of letters in ``text``, lower-cased, and the number of documents that have them; all that
    ``least_docs`` documents have.

    All documents count. Values in credential contexts don't, so that a secret that is copied often is not a word.
    """
    # A blank keeps what stands before and after apart.
    prose = F.regexp_replace(F.col("text").cast("string"), _CONTEXT.pattern, " ")
    text = F.when(F.col("text").rlike("[:=]"), prose).otherwise(F.col("text").cast("string"))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])\p{{L}}{{3,{LONGEST}}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    return docs.select(F.explode(F.array_distinct(found)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)


@lru_cache(maxsize=2)
def vocabulary_words(json_path: str) -> tuple[str, ...]:
    """Whole words of a public byte-level vocabulary, ASCII letters, lower-cased, in the order of its ids, which is about
    that of their frequency. Bounded by the vocabulary."""
    with open(json_path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = (t[1:] for t in sorted(ids, key=ids.__getitem__) if t[0] == "\u0120" and t[1:].isascii() and t[1:].isalpha())
    return tuple(dict.fromkeys(w.lower() for w in whole if 3 <= len(w) <= LONGEST))


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether ``spans`` together hold all of ``[start, end)``."""
    for a, _, b in sorted(spans):
        if a > start:
            break
        start = max(start, b)
    return start >= end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns' findings; ends are exclusive, in code points."""
    found: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def open_values(text: str, base: list[tuple[int, int, int]], min_chars: int = 8) -> list[tuple[int, int]]:
    """``(start, end)`` of values in credential contexts that ``base`` spans don't hold whole."""
    out = []
    if ":" in text or "=" in text:
        for m in _CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            bare = end if m.lastindex < 3 else start + len(text[start:end].rstrip(")]}.:!?"))  # closers after an unquoted value are not its rest
            if end - start >= min_chars and not _covered(start, bare, base):
                out.append((start, end))
    return out


def is_secret(value: str, min_cost: float = 10.0, min_per_char: float = 0.0, ranks: Mapping[str, int] | None = None) -> bool:
    """Whether ``value`` costs ``min_cost`` and, if it has letters, ``min_per_char`` for each character; powers of ten.

    The second bound is for identifiers, paths and references, which are long but made of words. It lets go phrases of
    several dictionary words as well, which differ from those in nothing that a cost could tell.
    """
    return guess_cost(value, ranks) >= (max(min_cost, min_per_char * len(value)) if any(map(str.isalpha, value)) else min_cost)


def scan_text(text: str, min_cost: float = 10.0, min_chars: int = 8, ranks: Mapping[str, int] | None = None, min_per_char: float = 0.0) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all findings in one text, by start and then kind."""
    base = base_spans(text)
    return sorted(base + [(a, 3, b) for a, b in open_values(text, base, min_chars) if is_secret(text[a:b], min_cost, min_per_char, ranks)])


def _spotted(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, base, asked)``: the spans of the fixed patterns, and the values to be costed with their places."""
    span = [("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]
    base_type, asked_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("value", pa.string())]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, asked = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                base.append([{"start": a, "k": k, "end": b} for a, k, b in found])
                asked.append([{"start": a, "k": 3, "end": b, "value": text[a:b]} for a, b in open_values(text or "", found, min_chars)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(asked, asked_type)], names=["doc_id", "base", "asked"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, base array<struct<start: int, k: int, end: int>>, asked array<struct<start: int, k: int, end: int, value: string>>")


def _pieces(values: DataFrame) -> DataFrame:
    """``(key, w)``: each stretch of letters in a value, look-alike characters read as letters, that could be a word."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = value.lower()
                plain = low.translate(_LEET) if len(low) == len(value) else value
                for start in range(0, len(plain), 4096):
                    found = {plain[a:b] for a in range(start, min(start + 4096, len(plain))) for b in range(a + 3, min(a + LONGEST, len(plain)) + 1) if plain[a:b].isalpha()}
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), pa.array(list(found))], names=["key", "w"])

    return values.mapInArrow(run, "key string, w string").distinct()


def word_ranks(values: DataFrame, counts: DataFrame) -> DataFrame:
    """``(key, value)`` and ``(w, n)`` -> ``(key, ranks)``: of each value the words that it holds, with their ranks.

    A word's rank is the number of fixed words and of words at least as frequent; frequencies are as alike as bins of a
    sixteenth. So the order of words that tie plays no part, and no list of all words is sorted or sent anywhere.
    """
    counts = materialize(counts, "counts").withColumn("bin", sketch_bin(F.col("n")))  # read twice
    bins = counts.groupBy("bin").agg(F.count("*").alias("words"))  # a thousand at most, as counts are longs
    bins = bins.select("bin", (F.sum("words").over(Window.orderBy(F.col("bin").desc())) + len(WORDS)).alias("rank"))
    pieces = materialize(_pieces(values), "pieces")
    known = counts.join(pieces.select("w").distinct(), "w", "left_semi").join(F.broadcast(bins), "bin").select("w", "rank")
    known = by_size(materialize(known, "known"), MAX_KEYS)
    return pieces.join(known, "w").groupBy("key").agg(F.collect_list(F.struct("w", "rank")).alias("ranks"))


def scan(docs: DataFrame, min_cost: float = 10.0, min_chars: int = 8, counts: DataFrame | None = None, json_path: str | None = None, min_per_char: float = 0.0) -> DataFrame:
    """``(doc_id, text)`` -> one row each: ``(doc_id, findings)``, an array of ``(kind, start, end)``.

    The dictionary is the fixed words, then the words of the vocabulary at ``json_path``, and beside them ``counts``, see
    :func:`word_counts`; of several ranks the least holds. ``counts`` may have any number of rows: each value meets the words
    that it holds in a join. Equal values are costed once, and values are equal if their SHA-256 is. See :func:`is_secret`
    for the two bounds.

    Null and empty texts have none. Rows that repeat are scanned each; a null doc_id stays null; extra columns are ignored.
    Values shorter than ``min_chars``, or that base spans hold whole, are not costed; one that they hold in part is costed
    whole and its span added. A scheme word (Bearer, Basic, Token) before a value is not part of it.
    """
    spotted = materialize(_spotted(docs, min_chars).withColumn("row", F.monotonically_increasing_id()), "spotted")
    asked = spotted.where(F.size("asked") > 0).select("row", F.explode("asked").alias("x")).withColumn("key", F.sha2("x.value", 256))
    values = spread(materialize(asked.groupBy("key").agg(F.first("x.value").alias("value")), "values"))
    ranked = values.withColumn("ranks", F.expr("cast(array() as array<struct<w: string, rank: bigint>>)")) if counts is None else values.join(word_ranks(values, counts), "key", "left")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = ranks_of(vocabulary_words(json_path) if json_path else ())
        for batch in batches:
            keys = []
            for key, value, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {x["w"]: min(x["rank"], fixed.get(x["w"], x["rank"])) for x in ranks or ()}
                if is_secret(value, min_cost, min_per_char, ChainMap(own, fixed)):
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    costly = by_size(materialize(ranked.select("key", "value", "ranks").mapInArrow(run, "key string"), "costly"), MAX_KEYS)
    guessed = asked.join(costly, "key").groupBy("row").agg(F.collect_list(F.struct("x.start", "x.k", "x.end")).alias("guessed"))
    spans = F.array_sort(F.concat("base", F.coalesce("guessed", F.expr("cast(array() as array<struct<start: int, k: int, end: int>>)"))))
    named = F.transform(spans, lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return spotted.join(guessed, "row", "left").select("doc_id", named.alias("findings"))


def redact(text: str, findings: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every finding, overlaps merged, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(findings):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_sha256(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def digests(found: DataFrame) -> DataFrame:
    """Findings -> counts by base kind, the digest of the base spans and all spans as text."""
    base = F.filter("findings", lambda x: x["kind"] != KINDS[3])
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))
