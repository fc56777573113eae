"""Quality rules whose cut-offs follow the corpus, on DataFrame operations alone.

Ratios of each document go, as whole numbers, into log-linear histograms per language and source. A histogram is a
mergeable quantile sketch: adding counts bin by bin merges two of them exactly, in any order, and a bin is at most 1/16
wide, so every quantile is within that. The sketches of a language and of the corpus are sums of those of the groups.
A fence is ``tail + FENCE * (tail - median)``, with the quantiles read off the sketch, upper ends of their bins, and no
constant added; word length has one below as well. The fences of a language are drawn towards the corpus's as if ``PRIOR``
documents had those, and a group's towards its language's, so that a group speaks for itself the more the larger it is. A
document is dropped when one ratio lies beyond a fence of its group. A text's ratios leave its first symbol, repeated line
or capital out, as one alone can make any ratio in a short text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memtide.llm.rows import by_size
from memtide.llm.scratch import materialize

#: Ratio, quantile (per mille) that its fence starts from, and whether there is one below. Junk is full of symbols and of
#: overlong words, so those start inside what most documents do; repeats and capitals also occur in ordinary ones.
RULES = {
    "symbol_pm": (900, False),  # symbols beyond the first, per 1000 words
    "dup_line_pm": (990, False),  # repeated lines beyond the first, per 1000 lines
    "repeat_pm": (990, False),  # words in repeated windows per 1000 words
    "shout_pm": (990, False),  # capitals and exclamation marks beyond the first, per 1000 characters of words
    "word_len_cm": (900, True),  # mean characters of a word, times 100
}
FENCE = 3
#: Documents that the parent's fences count for.
PRIOR = 200
#: Groups whose limits may be sent to every task; more meet their documents in a shuffle.
MAX_GROUPS = 100_000
_SPACE = r"[\x20\x09-\x0D]+"


def base_stats(docs: DataFrame, window: int = 5) -> DataFrame:
    """``(doc_id, lang, source, text)`` -> one row each with counts of words, characters, symbols and repeats."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), F.array_remove(F.split(text, _SPACE), "").alias("ws"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"))
    gram = lambda i: F.xxhash64(*(F.get("ws", i + k) for k in range(window)))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", _SPACE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}!]+", "")).cast("bigint").alias("n_shout"),
        F.size("ls").cast("bigint").alias("n_full_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("ws") >= window, F.transform(F.sequence(F.lit(0), F.size("ws") - window), gram)).alias("h"),
    )
    # Nearly all texts repeat no window, and a set tells; only the others sort their windows.
    found = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("s", found).drop("h")
    again = F.filter("s", lambda x, i: (x["h"] == F.when(i > 0, F.get("s", i - 1)["h"])) | F.coalesce(x["h"] == F.get("s", i + 1)["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    count = F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(count, F.lit(0).cast("bigint"))).drop("s")


def ratios(stats: DataFrame) -> DataFrame:
    """Adds the ratios of RULES; null for a text without a word."""
    per = lambda a, b, k: F.expr(f"case when {b} > 0 then {k} * {a} div {b} end")
    return stats.withColumns({"symbol_pm": per("greatest(n_symbols - 1, 0)", "n_words", 1000), "dup_line_pm": per("greatest(n_dup_lines - 1, 0)", "n_full_lines", 1000), "repeat_pm": per("n_repeat_words", "n_words", 1000), "shout_pm": per("greatest(n_shout - 1, 0)", "word_chars", 1000), "word_len_cm": per("word_chars", "n_words", 100)})


def sketch_bin(value: Column) -> Column:
    """Lower end of the log-linear bin: exact below 32, then 16 bins to a power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group, ratio and bin: ``(*keys, ratio, bin, n)``. Spark adds up within tasks before it shuffles."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("value")) for r in RULES)))
    return rows.select(*keys, each.alias("x")).groupBy(*keys, F.col("x.ratio").alias("ratio"), sketch_bin(F.col("x.value")).alias("bin")).agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame, fence: int = FENCE, prior: int = PRIOR) -> DataFrame:
    """Sketches by lang and source -> ``(lang, source, hi_*, lo_*)``, each group's own cut-offs drawn to its parents'."""
    levels = F.expr("explode(array(named_struct('level', 0, 'a', lang, 'b', source), named_struct('level', 1, 'a', lang, 'b', cast(null as string)), named_struct('level', 2, 'a', cast(null as string), 'b', cast(null as string))))")
    merged = sketch.select(levels.alias("g"), "ratio", "bin", "n").groupBy("g.level", "g.a", "g.b", "ratio", "bin").agg(F.sum("n").alias("n"))
    group = ["level", "a", "b", "ratio"]
    up = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = merged.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(*group))})
    tail = F.expr(f"case ratio {' '.join(f"when '{r}' then {t}" for r, (t, _) in RULES.items())} end")
    top = F.expr("bin + shiftleft(1, greatest(length(bin(bin)) - 5, 0)) - 1")
    reach = lambda share, value: F.min(F.when(1000 * F.col("upto") >= share * F.col("total"), value))
    q = at.groupBy(*group).agg(F.max("total").alias("total"), reach(1000 - tail, F.col("bin")).alias("low"), reach(F.lit(500), top).alias("mid"), reach(tail, top).alias("high"))
    pick = []
    for name, (_, below) in RULES.items():
        here = lambda x, name=name: F.max(F.when(F.col("ratio") == name, x))
        pick.append(here(F.col("high") + fence * (F.col("high") - F.col("mid"))).alias(f"hi_{name}"))
        if below:
            pick.append(here(F.col("low") - fence * (F.col("mid") - F.col("low"))).alias(f"lo_{name}"))
    wide = q.groupBy("level", "a", "b").agg(F.max("total").alias("total"), *pick)
    names = [c for c in wide.columns if c[:3] in ("hi_", "lo_")]
    own, lang, every = (wide.where(f"level = {i}").select("a", "b", "total", *(F.col(c).alias(f"{c}_{i}") for c in names)) for i in range(3))
    joined = own.join(F.broadcast(every.drop("a", "b", "total")), F.lit(True), "left")  # one row
    joined = joined.alias("o").join(lang.select(F.col("a").alias("la"), F.col("total").alias("lt"), *(f"{c}_1" for c in names)), F.col("a").eqNullSafe(F.col("la")), "left")
    drawn = lambda n, own, parent: F.coalesce((F.col(n) * F.col(own) + prior * parent) / (F.col(n) + prior), parent)
    return joined.select(F.col("a").alias("lang"), F.col("b").alias("source"), *(drawn("total", f"{c}_0", drawn("lt", f"{c}_1", F.col(f"{c}_2").cast("double"))).alias(c) for c in names))


def quality_rules(docs: DataFrame, fence: int = FENCE, prior: int = PRIOR) -> DataFrame:
    """``(doc_id, text, lang, source)`` -> per row ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated windows of five. ``kept`` is false for
    those and for documents beyond a fence of their group. Sketches hold the documents that pass the base rules.
    Null and empty texts have no word and fail. Null languages and sources are groups like any other. Rows that repeat
    count each time; an empty table gives an empty one; columns beyond the four are ignored. Windows are compared by
    64-bit hashes within one text.
    """
    stats = ratios(base_stats(docs)).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    stats = materialize(stats, "stats")
    sketch = materialize(sketches(stats.where(~F.col("base_failed")), ["lang", "source"]), "sketch")  # read for each level
    limits = cutoffs(sketch, fence, prior).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    limits = by_size(materialize(limits, "limits"), MAX_GROUPS)  # a row a group: the documents are not shuffled on few keys
    judged = stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = F.lit(False)
    for name, (_, below) in RULES.items():
        beyond = beyond | (F.col(name) > F.col(f"hi_{name}"))
        if below:
            beyond = beyond | (F.col(name) < F.col(f"lo_{name}"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))).alias("kept"))


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]"
    ratio = ", ".join(f"('{r}', {r})" for r in RULES)
    lang = lambda c: f"coalesce((l.total * l.{c} + {PRIOR} * cast(e.{c} as double)) / (l.total + {PRIOR}), cast(e.{c} as double))"
    own = lambda c: f"coalesce((o.total * o.{c} + {PRIOR} * {lang(c)}) / (o.total + {PRIOR}), {lang(c)})"
    beyond = " or ".join(f"coalesce(s.{r} > {own(r)}, false)" for r in RULES)
    low = f"coalesce(s.word_len_cm < {own('low')}, false)"
    wide = ", ".join(f"max(high + {FENCE} * (high - mid)) filter (where ratio = '{r}') as {r}" for r in RULES)
    tail = f"case ratio {' '.join(f"when '{r}' then {t}" for r, (t, _) in RULES.items())} end"
    top = "bin + (1 << greatest(length(bin(bin)) - 5, 0)) - 1"
    return rf"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select doc_id, unnest(range(len(ws) - 4)) as i, ws from w where len(ws) >= 5),
k as (select doc_id, i, count(*) over (partition by doc_id, ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4], ws[i + 5]) as c from g),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from k where c > 1) group by doc_id),
b as (
  select w.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '{space}+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(length(regexp_replace(text, '[^\p{{Lu}}!]+', '', 'g')) as bigint) as n_shout,
    cast(len(ls) as bigint) as n_full, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from w left join c on w.doc_id = c.doc_id),
s as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when n_words > 0 then 1000 * greatest(n_symbols - 1, 0) // n_words end as symbol_pm, case when n_full > 0 then 1000 * greatest(n_dup_lines - 1, 0) // n_full end as dup_line_pm,
    case when n_words > 0 then 1000 * n_repeat_words // n_words end as repeat_pm, case when word_chars > 0 then 1000 * greatest(n_shout - 1, 0) // word_chars end as shout_pm,
    case when n_words > 0 then 100 * word_chars // n_words end as word_len_cm from b),
v as (
  select unnest([struct_pack(level := 0, a := lang, b := source), struct_pack(level := 1, a := lang, b := null), struct_pack(level := 2, a := null, b := null)]) as g, r.ratio, r.v
  from s, lateral (values {ratio}) as r(ratio, v) where not base_failed),
h as (
  select g.level as level, g.a as a, g.b as b, ratio, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as bin, count(*) as n from v group by all),
u as (
  select *, sum(n) over (partition by level, a, b, ratio order by bin rows unbounded preceding) as upto, sum(n) over (partition by level, a, b, ratio) as total from h),
q as (
  select level, a, b, ratio, max(total) as total, min(bin) filter (where 1000 * upto >= (1000 - {tail}) * total) as low,
    min({top}) filter (where 2 * upto >= total) as mid, min({top}) filter (where 1000 * upto >= {tail} * total) as high from u group by all),
t as (select level, a, b, max(total) as total, {wide}, max(low - {FENCE} * (mid - low)) filter (where ratio = 'word_len_cm') as low from q group by level, a, b)
select s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, not s.base_failed and not ({beyond} or {low}) as kept
from s left join t o on o.level = 0 and o.a is not distinct from s.lang and o.b is not distinct from s.source
  left join t l on l.level = 1 and l.a is not distinct from s.lang left join t e on e.level = 2
"""


ORACLE = _oracle()
