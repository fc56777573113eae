"""Every operator as a query over the driver's tables, and the same in SQL where SQL can say it.

All ``embeddings`` stand for memories, with the text of the document of the same id or none: position and vector by id, one
hour between them. The searches ask every one whose id is divisible by 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memtide.functions import hooks
from memtide.functions import text as T
from memtide.functions.lifecycle import becomes_stale, content_dedup, lifecycle_score, memory_key
from memtide.functions.redact import MARK, PATTERNS, redact
from memtide.functions.rules import SCRIPT_BLOCKS, default_packs
from memtide.functions.vec import norm
from memtide.operators import filtering, gate, markov, metrics, pivots, prototypes, retrieval, skills
from memtide.plans.lineage import drain
from memtide.sources import embedding, store
from memtide.sources.scan import spread
from memtide.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "timestamp_ntz'2024-03-01 00:00:00'"


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "embeddings", "conversations") else df


def _vec(column: str = "embedding") -> Column:
    return F.col(column).cast("array<double>")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "embeddings")
    joined = e.join(d, F.col("doc_id") == F.col("vec_id"), "left")
    n = F.col("vec_id")
    return joined.select(n.alias("pos"), F.coalesce("text", F.lit("")).alias("text"), _vec().alias("embedding"), F.expr("timestampadd(HOUR, cast(vec_id as int), timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"), (n % 7).alias("access_count"), (n % 3 + 1).cast("double").alias("importance"), F.lit(False).alias("stale"))


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory whose id is divisible by 50, asked for by its own vector and whole text."""
    return memories(spark, sf_dir).where("pos % 50 = 0").select(F.col("pos").alias("query_id"), "embedding", "text")


def life() -> Column:
    return lifecycle_score(F.col("created_at"), F.col("importance"), F.col("access_count"), F.col("stale"), F.expr(NOW))


#: Contributions are whole billionths, so that sums don't depend on their order.
BM25 = "sum(round((times * greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 0.25)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1000000000)::bigint)::bigint / 1000000000.0::double"

MEM = f"""
mem as (
  select e.vec_id as pos, coalesce(d.text, '') as text, e.embedding::double[] as embedding, timestamp '2024-01-01' + to_hours(e.vec_id) as created_at, e.vec_id % 7 as access_count, cast(e.vec_id % 3 + 1 as double) as importance
  from embeddings e left join documents d on d.doc_id = e.vec_id),
q as (select pos as query_id, embedding, text from mem where pos % 50 = 0),
"""
MEM += f"""vec as (select q.query_id, mem.pos, list_dot_product(q.embedding, mem.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(mem.embedding, mem.embedding))) as score from q, mem),
toks as (select pos, regexp_extract_all(lower(text), '[a-z0-9]+|[^\\x00-\\x7f]') as t from mem),
stat as (select count(*) as n, avg(len(t)) as avgdl from toks),
term as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[^\\x00-\\x7f]')) as term from q) group by all),
tf as (select pos, dl, term, count(*) as tf from (select pos, len(t) as dl, unnest(t) as term from toks) where term in (select term from term) group by all),
df as (select term, count(*) as df from tf group by term),
bm as (
  select query_id, pos, {BM25} as score
  from tf join df using (term) join term using (term), stat group by all having score > 0),
rr as (select query_id, pos, row_number() over (partition by query_id order by round(score, 9) desc, pos) as rank from vec
  union all select query_id, pos, row_number() over (partition by query_id order by round(score, 9) desc, pos) from bm),
rrf as (select query_id, pos, sum(1.0::double / (60 + rank)) as score from rr group by all)
"""


@query("""
with e as (select vec_id, embedding::double[] as embedding from embeddings),
q as (select * from e where vec_id % 50 = 0),
vec as (select q.vec_id as query_id, e.vec_id as pos, list_dot_product(q.embedding, e.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding))) as score from q, e)
select query_id, pos, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, pos) as r from vec) where r <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), _vec().alias("embedding"))
    return retrieval.vector_top(e.where("pos % 50 = 0").withColumnRenamed("pos", "query_id"), e, 10).select("query_id", "pos", F.round("score", 6).alias("score"))


_BM25_DOCS = rf"""
with toks as (select doc_id as pos, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^\x00-\x7f]') as t from documents),
stat as (select count(*) as n, avg(len(t)) as avgdl from toks),
tf as materialized (select pos, dl, term, count(*) as tf from (select pos, len(t) as dl, unnest(t) as term from toks) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select q.pos as query_id, tf.pos, {BM25} as score from tf join df using (term) join (select pos, term, tf as times from tf where pos % 50 = 0) q using (term), stat group by all)
"""


#: To six places from whole billionths, as neither engine's own rounding of halves can be told from the other's.
_SIX = "((score * 1000000000)::bigint + 500) // 1000 / 1000000.0::double as score"


def _six(score: Column) -> Column:
    units = F.round(score * 1_000_000_000).cast("bigint") + 500
    return ((units - F.pmod(units, F.lit(1000))) / 1000 / 1_000_000.0).alias("score")


@query(f"{_BM25_DOCS} select query_id, pos, {_SIX} from s")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return retrieval.bm25_scores(docs.where("pos % 50 = 0").withColumnRenamed("pos", "query_id"), docs).select("query_id", "pos", _six(F.col("score")))


@query(f"{_BM25_DOCS} select query_id, pos, {_SIX}, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, pos) as rank from s) where rank <= 50")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return retrieval.bm25_top(docs.where("pos % 50 = 0").withColumnRenamed("pos", "query_id"), docs, 50).select("query_id", "pos", _six(F.col("score")), "rank")


@query(f"with {MEM} select query_id, pos, round(score, 9) as score from rrf")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank_fusion(question(spark, sf_dir), memories(spark, sf_dir)).select("query_id", "pos", F.round("score", 9).alias("score"))


@query(f"""with {MEM}, v as (select query_id, pos, 0.7 * (score - min(score) over w) / (max(score) over w - min(score) over w) as s from vec window w as (partition by query_id)
  union all select query_id, pos, 0.3 * (score - min(score) over w) / (max(score) over w - min(score) over w) from bm window w as (partition by query_id))
select query_id, pos, round(sum(s), 6) as score from v group by all""")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.weighted_search(question(spark, sf_dir), memories(spark, sf_dir), 0.7, 0.3).select("query_id", "pos", F.round("score", 6).alias("score"))


def _recall_sql(combined: str, k: int, similarity: float = 0.3) -> str:
    return f"""with recursive {MEM},
f as (select query_id, pos, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as score from rrf window w as (partition by query_id)),
c as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, pos) as r from f) where r <= 50),
l as (select c.query_id, c.pos, c.score as r, mem.embedding, pow(2.0, -(epoch(timestamp '2024-03-01' - created_at) / 86400.0) / 30) + importance + 0.5 * ln(1 + access_count) as l from c join mem using (pos)),
n as (select *, case when max(l) over w = min(l) over w then (case when max(l) over w > 0 then 1.0 else 0.0 end) else (l - min(l) over w) / (max(l) over w - min(l) over w) end as l1 from l window w as (partition by query_id)),
s as (select query_id, pos, embedding, {combined} as score from n),
o as (select *, row_number() over (partition by query_id order by round(score, 9) desc, pos) as i from s),
g as (
  select query_id, i, [i] as kept from o where i = 1
  union all
  select o.query_id, o.i, case when exists (select 1 from o p where p.query_id = o.query_id and list_contains(g.kept, p.i) and list_cosine_similarity(p.embedding, o.embedding) >= {similarity}) then g.kept else list_append(g.kept, o.i) end
  from g join o on o.query_id = g.query_id and o.i = g.i + 1),
e as (select query_id, arg_max(kept, i) as kept from g group by query_id),
z as (select o.query_id, o.pos, o.score, row_number() over (partition by o.query_id order by o.score desc, o.pos) as rank from o join e on o.query_id = e.query_id and list_contains(e.kept, o.i))
select query_id, cast(rank as int) as rank, pos, round(score, 6) as score from z where rank <= {k}"""


@query(_recall_sql("r * (1 + 0.3 * l1)", 20))
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall(question(spark, sf_dir), memories(spark, sf_dir), life(), retrieval.RecallConfig(top_k=20, similarity=0.3))


@query(_recall_sql("0.7 * r + 0.3 * l1", 20))
def recall_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall(question(spark, sf_dir), memories(spark, sf_dir), life(), retrieval.RecallConfig(top_k=20, similarity=0.3, additive=True))


@query(_recall_sql("r * (1 + 0.3 * l1)", 5, 0.9))
def recall_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall(question(spark, sf_dir), memories(spark, sf_dir), life())


@query("""
with e as (select vec_id, label, embedding::double[] as v from embeddings),
n as (select c.vec_id as pos, x.vec_id as other, list_cosine_similarity(c.v, x.v) as s from e c, e x where c.label < 5 and x.label >= 5 and round(list_cosine_similarity(c.v, x.v), 9) >= 0.3),
b as (select pos, cast(arg_max(other, (round(s, 9), -other)) as varchar) as similar_memory from n group by pos)
select e.vec_id as pos, b.pos is null as ok, case when b.pos is not null then 'duplicate' end as reason, similar_memory from e left join b on e.vec_id = b.pos where label < 5""")
def duplicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("text"), _vec().alias("embedding"), "label")
    out = gate.duplicate_gate(e.where("label < 5").drop("label"), e.where("label >= 5").drop("label"), 0.3)
    return out.select("pos", "ok", "reason", "similar_memory")


@query("""
with m as (select doc_id as pos, text, timestamp '2024-01-01' + to_hours(doc_id // 2) as created_at, sha256(text) as h from documents),
r as (select pos, min(pos) over (partition by h) as first_pos, row_number() over (partition by h order by created_at desc, pos) as r, h as content_hash from m)
select pos, first_pos, content_hash from r where r = 1""")
def content_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.expr("timestampadd(HOUR, cast(doc_id div 2 as int), timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"))
    return content_dedup(d).select("pos", "first_pos", F.sha2("text", 256).alias("content_hash"))


@query("""
with a as (select doc_id as pos, text, lang as created_at, 0 as src from documents where lang in ('en', 'fr') union all select doc_id, text, lang, 1 from documents),
r as (select *, row_number() over (partition by sha256(text || '::' || created_at) order by src, pos) as r from a),
k as (select pos, created_at, sha256(text || '::' || created_at) as key, src from r where r = 1)
select case when src = 0 then pos else (select max(doc_id) from documents where lang in ('en', 'fr')) + row_number() over (partition by src order by pos) end as pos, created_at, key from k""")
def merge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.col("lang").alias("created_at"))
    return store.merge_memories(d.where("created_at in ('en', 'fr')"), d).select("pos", "created_at", memory_key(F.col("text"), F.col("created_at")).alias("key"))


@query("""
select event_id, round(1.0 * pow(2.0, -(epoch(timestamp '2024-03-01' - ts) / 86400.0) / 30) + value + 0.5 * ln(1 + user_id % 4), 6) as score,
  epoch(timestamp '2024-03-01' - ts) / 86400.0 > 45 and user_id % 4 < 1 and value <= 50 as stale from events""")
def lifecycle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, now = F.col("user_id") % 4, F.expr(NOW)
    score = lifecycle_score(F.col("ts"), F.col("value"), n, F.lit(False), now)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"), becomes_stale(F.col("ts"), F.col("value"), n, F.lit(False), now, max_age_days=45, min_importance=50).alias("stale"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 20")
def bounded_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"))
    return store.bounded(e, 20, by="user_id").select("user_id", "event_id")


_PUNCT = r"[\s.,;:!?。，；：！？·•・、''«»„“”‘’]"
_STATS = r"""
s0 as (select *, length(bare) as n, list_distinct(string_split(bare, '')) as kinds, string_split(bare, '') as chars from src),
s1 as (
  select *, case when n = 0 then 0 else list_sum(list_transform(kinds, lambda c: -((n - length(replace(bare, c, ''))) / n::double) * log2((n - length(replace(bare, c, ''))) / n::double))) end as entropy,
    case when n < 2 then 0 else len(list_filter(range(2, n + 1), lambda i: chars[i] = chars[i - 1])) / (n - 1)::double end as repetition,
    case when n = 0 then 0 else (n - length(regexp_replace(bare, '""" + _PUNCT.replace("''", "''''") + r"""', '', 'g'))) / n::double end as punctuation from s0),
s2 as (select *, case when len(kinds) <= 1 then 0 else entropy / log2(len(kinds)) end as density from s1)"""
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"with src as (select doc_id, text as bare from documents), {_STATS} select doc_id, round(entropy, 6) as entropy, round(density, 6) as density, round(repetition::double, 6) as repetition, round(punctuation::double, 6) as punctuation from s2")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    r = lambda c, n: F.round(c, 6).alias(n)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", T.shannon_entropy(t).alias("e"), T.distinct_chars(t).alias("k"))
    density = F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(F.col("e") / F.log2(F.col("k").cast("double")))
    return rows.select("doc_id", r(F.col("e"), "entropy"), r(density, "density"), r(T.repetition_ratio(t), "repetition"), r(T.punctuation_ratio(t), "punctuation"))


def _split_sql(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace(trim({x}, {_TRIM}), '([。！？])\s*', '\1' || chr(1), 'g'), '([.!?])(\s+|$)', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s, {_TRIM})), lambda s: s <> '')"


@query(f"""
with s as (select conv_id, turn, {_split_sql("text")} as s from conversations)
select conv_id, turn, unnest(range(len(s))) as n, unnest(s) as sentence from s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return s.select("conv_id", "turn", F.col("n").cast("bigint").alias("n"), "sentence")


def _script_sql(x: str, script: str) -> str:
    low, high = SCRIPT_BLOCKS[script]
    return rf"(length({x}) - length(regexp_replace({x}, '[\x{{{low:04X}}}-\x{{{high:04X}}}]', '', 'g')))"


_KNOWN = " + ".join(_script_sql("text", s) for s in SCRIPT_BLOCKS)


@query(f"""select doc_id, {_script_sql("text", "Latin")} as latin, {_script_sql("text", "CJK")} as cjk, {_script_sql("text", "Cyrillic")} as cyrillic, {_script_sql("text", "Latin")} >= 0.15 * ({_KNOWN}) and {_script_sql("text", "Latin")} > 0 as is_latin from documents""")
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    n = lambda s: T.script_count(t, s).cast("bigint").alias(s.lower())
    return table(spark, sf_dir, "documents").select("doc_id", n("Latin"), n("CJK"), n("Cyrillic"), F.array_contains(T.detect_scripts(t), "Latin").alias("is_latin"))


#: Synthetic rows that reach branches the tables don't.
SAMPLES = ("", "ok", "继续", "可以。OK。接下来我们讨论一下架构设计。", "可以。好的。谢谢。再见。", "哈哈哈哈哈哈哈哈哈哈", "Thanks. Ok. Bye.", "ok. sure!", "We decided to always use Spark. It is important!", "12345 67890", "?!?!... --", "aaaaaaaaaabbbbbbbbbb", "hello ok. Fine.", "ok then, whatever that means", "これは重要な決定です。", "  padded text here  ", "Привет, как дела сегодня?")


def _samples_sql() -> str:
    return "select cast(a as bigint) as conv_id, cast(-1 as bigint) as turn, b as text from (values " + ", ".join(f"({-i - 1}, '{s}')" for i, s in enumerate(SAMPLES)) + ") as t(a, b)"


def _with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(-i - 1, -1, s) for i, s in enumerate(SAMPLES)], "conv_id bigint, turn bigint, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(rows)


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _filter_sql(hook: bool) -> str:
    packs = default_packs()
    east = " + ".join(_script_sql("bare", s) for s in ("CJK", "Hiragana", "Katakana", "Hangul"))
    known = " + ".join(_script_sql("bare", s) for s in SCRIPT_BLOCKS)
    low = "lower(regexp_replace({}, '[。.!?！？]+$', ''))"
    small = lambda s: f"((latin and list_contains({_list(packs[0].small_talk)}, {low.format(s)})) or (east and list_contains({_list(packs[1].small_talk)}, {low.format(s)})))"
    score = lambda p: f"greatest(0.0::double, least(1.0::double, 0.5::double + 0.08::double * len(list_filter({_list(p.high)}, lambda w: contains(lower(told), w))) - 0.1::double * len(list_filter({_list(p.low)}, lambda w: lower(told) = w or starts_with(lower(told), w || ' ')))))"
    common = f"""
with src as (select conv_id, turn, trim(text, {_TRIM}) as bare from (select conv_id, turn, text from conversations union all {_samples_sql()})), {_STATS},
s3 as (
  select *, case when n < 2 then 'too_short' when density < 0.3 then 'low_density' when repetition > 0.5 then 'high_repetition' when punctuation > 0.7 then 'high_punctuation'
    when regexp_full_match(regexp_replace(bare, '\\s', '', 'g'), '[0-9]*') then 'pure_digits' end as why from s2),
"""
    if not hook:
        return common + "d as (select conv_id, turn, case when bare = '' then 'empty' when n < 1 then 'too_short' when why is not null then why else 'passed' end as reason from s3) select conv_id, turn, reason = 'passed' as store, case when reason = 'passed' then 0.5::double else 0.0::double end as score, reason from d"
    share = " or ".join(f"({_script_sql('bare', s)} > 0 and {_script_sql('bare', s)} / ({known})::double >= 0.15)" for s in ("CJK", "Hiragana", "Katakana", "Hangul"))
    return (
        common
        + f"""
g as (select *, ({known}) > 0 and {_script_sql("bare", "Latin")} > 0 and {_script_sql("bare", "Latin")} / ({known})::double >= 0.15 as latin, ({east}) > 0 and ({share}) as east, {_split_sql("bare")} as sents from s3),
t as (select *, list_filter(sents, lambda s: not {small("s")}) as kept from g),
u as (select *, array_to_string(kept, ' ') as told, case when len(sents) = 0 then 1.0 when not latin and not east then 0.0 else (len(sents) - len(kept)) / len(sents)::double end as ratio from t),
v as (select *, case when len(kept) = 0 then 0.0::double else coalesce(greatest(case when latin then {score(packs[0])} end, case when east then {score(packs[1])} end), 0.5::double) end as imp from u),
d as (
  select *, case when bare = '' then 'empty' when n < 5 then 'too_short' when why is not null then why when ratio > 0.85 then 'mostly_small_talk' when imp < 0.35 then 'low_importance' else 'passed' end as reason from v)
select conv_id, turn, reason = 'passed' as store, round(case when reason in ('passed', 'low_importance') then imp else 0.0::double end, 6) as score, reason from d"""
    )


@query(_filter_sql(False))
def filter_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.decide(_with_samples(spark, sf_dir), source="mcp").select("conv_id", "turn", "store", "score", "reason")


@query(_filter_sql(True))
def filter_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.decide(_with_samples(spark, sf_dir), source="hook").select("conv_id", "turn", "store", F.round("score", 6).alias("score"), "reason")


SECRETS = ("my key sk-abcdefghij0123456789 ok", "API_KEY = 'abcdef0123456789abcd'", "ghp_abcdefghijklmnopqrstuvwxyz0123456789", "eyJhbGciOi.eyJzdWIi.c2ln end", "Authorization: Bearer abc.def-123", "password: hunter2hunter", "https://me:pw123@host.example/x", "DB_TOKEN=abcd1234efgh and more", "I decided to use Python for the backend.")


def _redact_sql(x: str) -> str:
    for _, pattern in PATTERNS:
        rule = pattern.replace("(?iu)", "(?i)").replace("(?isu)", "(?is)").replace("'", "''")
        x = f"regexp_replace({x}, '{rule}', '{MARK}', 'g')"
    return x


@query(f"""
with t as (select doc_id, text from documents union all select a, b from (values {", ".join(f"({-i - 1}, '" + s.replace("'", "''") + "')" for i, s in enumerate(SECRETS))}) as v(a, b)),
r as (select doc_id, text, {_redact_sql("text")} as red from t)
select cast(doc_id as bigint) as doc_id, sha256(red) as redacted_sha256, red <> text as changed from r""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-i - 1, s) for i, s in enumerate(SECRETS)], "doc_id bigint, text string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more).withColumn("red", redact(F.col("text")))
    return rows.select("doc_id", F.sha2("red", 256).alias("redacted_sha256"), (F.col("red") != F.col("text")).alias("changed"))


CLAIMS = ("I use Python", "I don't use Python", "The backend is running on port 8080", "The backend is not running on port 8080", "We like tea", "no we like tea", "She never writes the unit tests twice", "you write unit tests twice", "Plain words here")
_CORE = r"regexp_replace(lower(text), '^((i|we|they|he|she|it|you|the|a|an) )+', '')"
_DIRECT = " or ".join("x.core = '{0}' || y.core or y.core = '{0}' || x.core".format(n.replace("'", "''")) for n in gate.NEGATORS)


@query(f"""
with t as (select conv_id * 1000 + turn as pos, text from conversations union all select a, b from (values {", ".join(f"({-i - 1}, '" + s.replace("'", "''") + "')" for i, s in enumerate(CLAIMS))}) as v(a, b)),
r as (select pos, text, {_CORE} as core, len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9'']+'), {_list(gate.NEGATIONS)})) > 0 as neg from t),
w as (select *, list_distinct(regexp_extract_all(core, '[a-z0-9]+')) as w from r),
p as (select x.pos as i, y.pos as j, x.text as a, y.text as b, ({_DIRECT}) as direct, x.neg <> y.neg as polar, list_sort(list_intersect(x.w, y.w)) as shared from w x join w y on x.pos < y.pos)
select cast(i as bigint) as i, cast(j as bigint) as j, case when direct then 'negation: ''' || a || ''' vs ''' || b || '''' else 'opposite polarity on shared terms: [''' || array_to_string(shared, ''', ''') || ''']' end as hint
from p where direct or (polar and len(shared) >= 3)""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-i - 1, s) for i, s in enumerate(CLAIMS)], "pos bigint, text string")
    return gate.contradictions(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text").unionByName(more))


@query(ORACLES["vector_topk"])
def vector_topk_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vector_topk``, over an index that leaves out what is too far."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), _vec().alias("embedding"))
    found, _ = pivots.pivot_top(e.where("pos % 50 = 0").withColumnRenamed("pos", "query_id"), pivots.build_pivots(e), 10)
    return retrieval.truncate(found, 10).select("query_id", "pos", F.round("score", 6).alias("score"))


@query(ORACLES["duplicate_gate"])
def duplicate_gate_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``duplicate_gate``, over an index of the existing rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("text"), _vec().alias("embedding"), "label")
    old = e.where("label >= 5").drop("label")
    return gate.duplicate_gate(e.where("label < 5").drop("label"), old, 0.3, pivots.build_pivots(old)).select("pos", "ok", "reason", "similar_memory")


@query("""
with c as (select doc_id, unnest(list_transform(range(greatest(1, cast(ceil(length(text) / 4096.0) as bigint))), lambda i: substr(text, i * 4096 + 1, 4096))) as c from documents)
select doc_id, count(*) as n_chunks, round(avg(length(c)), 6) as mean_chars, round(avg(length(c) - length(replace(c, ' ', ''))), 6) as mean_blanks from c group by doc_id""")
def chunk_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(T.chunks(F.col("text"))).alias("c"))
    vectors = parts.select("id", F.array(F.length("c").cast("double"), (F.length("c") - F.length(F.replace("c", F.lit(" "), F.lit("")))).cast("double")).alias("v"))
    n = parts.groupBy("id").agg(F.count("*").alias("n_chunks"))
    return embedding.mean_pool(vectors).join(n, "id").select(F.col("id").alias("doc_id"), "n_chunks", F.round(F.get("embedding", F.lit(0)), 6).alias("mean_chars"), F.round(F.get("embedding", F.lit(1)), 6).alias("mean_blanks"))


PROTO = """
p as (select label as proto_id, arg_min(embedding, vec_id)::double[] as raw from embeddings group by label),
pr as (select proto_id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) as vec from p),
v as (select vec_id as id, embedding::double[] as e from embeddings),
sim as (select id, proto_id, vec, e, list_cosine_similarity(e, vec) as sim from v, pr)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _vec().alias("embedding"))


def protos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each label, at unit length."""
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return first.select(F.col("label").alias("proto_id"), prototypes.normalize(_vec("e")).alias("vec"), F.lit(1.0).alias("strength"), F.lit(0).cast("bigint").alias("access_count"), F.lit(-1).alias("created_step"), F.lit(-1).alias("last_access_step"))


@query(f"with {PROTO} select id, proto_id, round(exp(sim / 0.5) / sum(exp(sim / 0.5)) over (partition by id), 6) as weight from sim")
def activation_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = prototypes.activation_weights(vectors(spark, sf_dir), protos(spark, sf_dir), prototypes.LearningConfig(temperature=0.5))
    return w.select("id", "proto_id", F.round("weight", 6).alias("weight"))


@query(f"""with {PROTO}, r as (select *, rank() over (partition by id order by sim desc) as r from sim),
x as (select *, case when r <= 3 then exp(sim) else 0 end as e1 from r)
select id, proto_id, round(e1 / sum(e1) over (partition by id), 6) as weight from x""")
def activation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = prototypes.activation_weights(vectors(spark, sf_dir), protos(spark, sf_dir), prototypes.LearningConfig(top_k=3))
    return w.select("id", "proto_id", F.round("weight", 6).alias("weight"))


@query(f"""with {PROTO}, w as (select *, exp(sim) / sum(exp(sim)) over (partition by id) as w from sim),
u as (select id, w, unnest(vec) as x, unnest(e) as b, generate_subscripts(vec, 1) as d from w)
select id, d - 1 as dim, round(any_value(b) + 0.1 * sum(w * x), 6) as value from u group by id, d""")
def plastic_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prototypes.encode(vectors(spark, sf_dir), protos(spark, sf_dir)).select("id", F.posexplode("encoding").alias("dim", "value"))
    return out.select("id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(f"with {PROTO} select id, arg_max(proto_id, (round(sim, 12), -proto_id)) as proto_id, round(max(sim), 6) as sim from sim group by id")
def nearest_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.nearest(vectors(spark, sf_dir), protos(spark, sf_dir)).select("id", "proto_id", F.round("sim", 6).alias("sim"))


@query(f"""with {PROTO}, n as (select id, arg_max(proto_id, (round(sim, 12), -proto_id)) as proto_id from sim group by id)
select count(*) as updated, count(distinct proto_id) as unique_updated, 1.0::double as capacity_usage from n""")
def learn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = protos(spark, sf_dir)
    return prototypes.learn_report(prototypes.nearest(vectors(spark, sf_dir), before), before)


@query(f"""with recursive {PROTO},
n as (select id, arg_max(proto_id, (round(sim, 12), -proto_id)) as proto_id from sim group by id),
o as (select n.proto_id, v.e, row_number() over (partition by n.proto_id order by n.id) as i from n join v using (id)),
f as (
  select proto_id, 0::bigint as i, vec as v, 1.0::double as s from pr
  union all
  select proto_id, i, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))), least(s + 1 / (1 + 0.2 * (i - 1)), 5.0) from (
    select f.proto_id, o.i, f.s, list_transform(range(1, len(f.v) + 1), lambda d: f.v[d] + 0.1 / (1 + 0.01 * f.i) * list_dot_product(f.v, o.e) * (o.e[d] - list_dot_product(f.v, o.e) * f.v[d])) as raw
    from f join o on o.proto_id = f.proto_id and o.i = f.i + 1)),
z as (select proto_id, max(i) as n, arg_max(v, i) as v, arg_max(s, i) as s from f group by proto_id)
select proto_id, n as access_count, cast(case when n > 0 then 1 else -1 end as int) as created_step, round(s * 0.995, 6) as strength, unnest(range(len(v))) as dim, round(0.995 * unnest(v), 6) as value from z""")
def oja_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prototypes.learn(vectors(spark, sf_dir), protos(spark, sf_dir), step=1)
    return out.select("proto_id", "access_count", "created_step", F.round("strength", 6).alias("strength"), F.posexplode("vec").alias("dim", "value")).withColumns({"value": F.round("value", 6), "dim": F.col("dim").cast("bigint")})


@query(f"""with {PROTO}, w as (select *, exp(sim) / sum(exp(sim)) over (partition by id) as w from sim),
u as (select id, w, unnest(vec) as x, generate_subscripts(vec, 1) as d from w), r as (select id, d, 0.1 * sum(w * x) as r from u group by id, d)
select round(avg(n), 6) as residual_norm from (select id, sqrt(sum(r * r)) as n from r group by id)""")
def residual_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.residual_norm(vectors(spark, sf_dir), protos(spark, sf_dir), prototypes.LearningConfig()).select(F.round("residual_norm", 6).alias("residual_norm"))


@query(f"with {PROTO} select proto_id, round((1 + proto_id) * pow(0.995, 100), 6) as strength, round(sqrt(list_dot_product(vec, vec)) * pow(0.995, 100), 6) as length from pr")
def decay_forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = prototypes.decayed(protos(spark, sf_dir).withColumn("strength", 1.0 + F.col("proto_id")), 100)
    return after.select("proto_id", F.round("strength", 6).alias("strength"), F.round(norm(F.col("vec")), 6).alias("length"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("item"))


EDGES = """e as (select lag(event_type) over (partition by user_id order by ts, event_id) as prev, event_type as next from events),
m as (select prev, next, count(*) as cnt from e where prev is not null group by all)"""


@query(f"with {EDGES} select * from m")
def markov_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.transitions(steps(spark, sf_dir))


@query(f"with {EDGES} select prev, next, cnt from (select *, row_number() over (partition by prev order by cnt desc, next) as r from m) where r = 1")
def markov_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.predict_next(markov.transitions(steps(spark, sf_dir)))


@query(f"""with {EDGES}, i as (select distinct event_type as x from events union all select 'unseen'), t as (select prev, sum(cnt) as total from m group by prev)
select a.x as prev, b.x as next, round(case when total is null then 1.0 else 1 - (coalesce(cnt, 0) + 1.0) / (total + 6.0) end, 6) as surprise
from i a cross join i b left join t on t.prev = a.x left join m on m.prev = a.x and m.next = b.x""")
def markov_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = markov.transitions(steps(spark, sf_dir))
    items = table(spark, sf_dir, "events").select(F.col("event_type").alias("x")).distinct().unionByName(spark.createDataFrame([("unseen",)], "x string"))
    pairs = items.select(F.col("x").alias("prev")).crossJoin(items.select(F.col("x").alias("next")))
    return markov.surprise(edges, pairs, 6).select("prev", "next", F.round("surprise", 6).alias("surprise"))


@query("""
with e as (select vec_id, label, embedding::double[] as v from embeddings)
select a.label, count(distinct a.vec_id) as n, round(sum(case when a.vec_id <> b.vec_id then list_cosine_similarity(a.v, b.v) else 0 end) / (count(distinct a.vec_id) * (count(distinct a.vec_id) - 1)), 6) as mean_similarity
from e a join e b on a.label = b.label group by a.label""")
def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pairwise_similarity(table(spark, sf_dir, "embeddings"), "label").select("label", "n", F.round("mean_similarity", 6).alias("mean_similarity"))


@query("""
select case when grouping(lang) = 1 then 'overall' else 'by_type' end as scope, lang, count(*) as n, round(avg(quality), 4) as recall_at_k, round(avg(toxic), 4) as qa_accuracy
from documents join labels using (doc_id) group by grouping sets ((), (lang))""")
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.grouped_metrics(rows, "lang", "quality", "toxic")


@query("""
with c as (select conv_id, list_distinct(list(role)) as r from conversations group by conv_id)
select conv_id, list_contains(r, 'system') or list_contains(r, 'assistant') as recall_hit from c""")
def set_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.collect_set("role").alias("session_ids"))
    gold = found.select("question_id", F.array(F.lit("system"), F.lit("assistant")).alias("session_ids"))
    return metrics.set_hits(found, gold).select(F.col("question_id").alias("conv_id"), "recall_hit")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shell commands and calls of other tools."""
    text = F.concat(F.lit("run "), F.col("event_type"), F.lit(" --user "), F.col("user_id").cast("string"), F.lit(" --k "), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")))
    tool = F.when(F.col("event_id") % 5 == 0, F.initcap("event_type")).otherwise("Shell")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).cast("string").alias("workspace"), tool.alias("tool"), text.alias("command"), (F.col("event_type") != "error").alias("ok"), "event_type")


CMD = """c as (
  select event_id, cast(user_id % 10 as varchar) as workspace, case when event_id % 5 = 0 then upper(event_type[1]) || event_type[2:] else 'Shell' end as tool,
    'run ' || event_type || ' --user ' || user_id || ' --k ' || coalesce(json_extract_string(props, '$.k'), 'none') as command, event_type <> 'error' as ok, event_type from events),
k as (select *, case when tool = 'Shell' then 'Shell:run ' || event_type else 'Tool:' || tool end as cluster_key from c)"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).withColumn("cluster_key", skills.cluster_key(F.col("tool"), F.col("command")))


@query(f"with {CMD} select event_id, cluster_key from k")
def cluster_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("event_id", "cluster_key")


@query(f"""with {CMD}, p as (select *, row_number() over (partition by workspace order by event_id) as p from k)
select event_id, count(*) over (partition by workspace, cluster_key order by p range between 49 preceding and current row) as repeat_count from p""")
def frustration_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.windowed_counts(keyed(spark, sf_dir)).select("event_id", "repeat_count")


@query()
def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.skeletons(keyed(spark, sf_dir))


@query()
def ready_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = skills.ready_clusters(skills.skeletons(keyed(spark, sf_dir)))
    return skills.extract_skills(ready, F.lit("2024-03-01")).select("id", "type", "name", "trigger_pattern", "confidence")


TEMPLATES = (("t1", 0, "run click --user {var} --k {var2}"), ("t2", 1, "run {any} --user 7 --k {x}"), ("t3", 2, "run view"), ("t4", 3, "run {a} --user {b} --k 1"))


@query(f"""with {CMD} select event_id, case
  when regexp_full_match(command, '\\s*run\\s+click\\s+--user\\s+\\S+\\s+--k\\s+\\S+\\s*') then 't1' when regexp_full_match(command, '\\s*run\\s+\\S+\\s+--user\\s+7\\s+--k\\s+\\S+\\s*') then 't2'
  when regexp_full_match(command, '\\s*run\\s+view\\s*') then 't3' when regexp_full_match(command, '\\s*run\\s+\\S+\\s+--user\\s+\\S+\\s+--k\\s+1\\s*') then 't4' end as skill_id from c""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([(i, p, t, None, False) for i, p, t in TEMPLATES], "id string, position int, template string, expansion string, deprecated boolean")
    return skills.match_templates(commands(spark, sf_dir), s).select("event_id", "skill_id")


@query("""
with recursive o as (select user_id as skill_id, event_type <> 'error' as ok, row_number() over (partition by user_id order by event_id) as i from events),
f as (
  select skill_id, 0::bigint as i, 0.8::double as c, 0 as u, 0 as f, false as d from (select distinct skill_id from o)
  union all
  select o.skill_id, o.i, case when ok then least(1.0, 0.9 * c + 0.1) else greatest(0.0, 0.95 * c - 0.05) end, u + ok::int, f + (not ok)::int,
    d or f + (not ok)::int >= 5 or (u + ok::int >= 5 and case when ok then least(1.0, 0.9 * c + 0.1) else greatest(0.0, 0.95 * c - 0.05) end < 0.5)
  from f join o on o.skill_id = f.skill_id and o.i = f.i + 1)
select skill_id, round(arg_max(c, i), 6) as confidence, arg_max(u, i) as usage_count, arg_max(f, i) as failure_count, arg_max(d, i) as deprecated from f group by skill_id""")
def skill_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("skill_id"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return skills.confidence_fold(o).select("skill_id", F.round("confidence", 6).alias("confidence"), "usage_count", "failure_count", "deprecated")


@query("""
with s as (select user_id as id, 0.8 + 0.2 * avg((event_type = 'click')::int) as c, count(*) as u, max(ts) as t from events group by user_id)
select id, round(c, 6) as confidence, u as usage_count from s where c >= 0.82 order by c * (1 + u) desc, t desc, id limit 10""")
def skill_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((0.8 + 0.2 * F.avg((F.col("event_type") == "click").cast("int"))).alias("confidence"), F.count("*").alias("usage_count"), F.max("ts").cast("string").alias("last_used"))
    top = skills.select_skills(e.withColumn("deprecated", F.lit(False)), 0.82, 10)
    return top.select("id", F.round("confidence", 6).alias("confidence"), "usage_count")


COMMANDS = ("ls -la", "git status", "git push", "GIT log", "rm -rf x", "", "git", "cat a | wc", "  head f")


@query("select event_id, [true, true, false, true, false, false, false, true, true][event_id % 9 + 1] and user_id % 4 < 3 as safe from events")
def safe_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command of every event, with the user's number as its last word; those of every fourth user are another tool's."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % len(COMMANDS)
    command = F.concat_ws(" ", F.get(F.array(*map(F.lit, COMMANDS)), n.cast("int")), F.col("user_id").cast("string"))
    return e.select("event_id", skills.is_safe(F.when(F.col("user_id") % 4 < 3, "Shell").otherwise("Read"), command).alias("safe"))


@query("""
with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations)
select conv_id, turn, role, length(text) as n_chars from r where r <= 2 and role in ('user', 'assistant') and text <> ''""")
def last_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", F.inline(hooks.last_exchange(F.col("m")))).select("conv_id", "turn", "role", F.length("content").cast("bigint").alias("n_chars"))


def _summary_sql() -> str:
    short = f"case when length(b) <= 150 then b else (case when contains(substr(b, 1, 150), ' ') then regexp_replace(substr(b, 1, 150), ' [^ ]*$', '') else substr(b, 1, 150) end) || '…' end"
    case = ""
    for mark, size in (("chr(10) || chr(10)", 2), ("'。'", 1), ("'. '", 2), ("'?'", 1), ("'!'", 1)):
        first = f"trim(substr(b, 1, instr(b, {mark}) + {size - 1}), {_TRIM})"
        case += f" when instr(b, {mark}) > 1 then case when length({first}) <= 150 then {first} else {short} end"
    return f"with t as (select conv_id, turn, role, trim(text, {_TRIM}) as b from conversations) select conv_id, turn, case when role <> 'assistant' then b{case} else {short} end as summary from t"


@query(_summary_sql())
def summarize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hooks.summarize(F.col("text"), F.col("role")).alias("summary"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("""select conv_id, turn, case (conv_id + turn) % 7 when 2 then text || case when text = '' then '' else chr(10) end || 'd' when 5 then '' when 6 then case when text = '' then 'g' else text end else text end as user_text from conversations""")
def user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text in the places of a payload where it may stand, one after the other, and in none."""
    t = F.col("text")
    struct = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    shapes = [struct(user_prompt=t), struct(prompt=t), struct(prompt=F.array(part("text", t), part("image", F.lit(None).cast("string")), part("text", F.lit("d")))), struct(hook_input=F.struct(t.alias("content"))), struct(matcher=t), F.concat(F.lit("not json "), t), struct(user_prompt=t, prompt=F.lit("g"))]
    payload = F.get(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % len(shapes)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hooks.user_text(payload).alias("user_text"))


@query("""select event_id, case event_id % 7 when 0 then user_id % 3 = 0 when 1 then event_type = 'click' when 2 then user_id % 2 = 0 when 3 then event_type = 'view' when 4 then user_id % 2 = 1 when 5 then true end as ok from events""")
def tool_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tool returned, in all its forms: exit code, boolean, text, success, error, output, and nothing."""
    user, kind = F.col("user_id"), F.col("event_type")
    told = [
        F.struct((user % 3).alias("exit_code")), kind == "click", F.when(user % 2 == 0, kind).otherwise(F.concat(F.lit("Error: "), kind)),
        F.struct((kind == "view").alias("success")), F.struct(F.when(user % 2 == 0, kind).alias("error"), F.lit("x").alias("stdout")), F.struct(kind.alias("stdout")), F.lit(None).cast("string"),
    ]
    payload = F.get(F.array(*(F.to_json(F.struct(x.alias("tool_result"))) for x in told)), (F.col("event_id") % len(told)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", hooks.tool_result(payload).alias("ok"))


@query("select doc_id from documents where text not in (select text from benchmark)")
def new_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.new_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id")


@query("""
with s as (select user_id as id, count(*) as n from events group by user_id), u as (select id, n * 10 as n from s where id % 3 = 0)
select s.id, coalesce(u.n, s.n) as usage_count, s.id % 2 = 0 as deprecated from s left join u using (id)""")
def upsert_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("usage_count")).withColumns({"created_at": F.lit("2024"), "deprecated": F.lit(False)})
    new = s.where("id % 3 = 0").withColumn("usage_count", F.col("usage_count") * 10)
    return store.deprecate_skills(store.upsert_skills(s, new), s.where("id % 2 = 0")).select("id", "usage_count", "deprecated")


@query(f"""with {MEM}, r as (select * from (select pos, text, row_number() over (order by round(score, 9) desc, pos) as r from vec join mem using (pos) where query_id = 0) where r <= 5)
select 'Relevant memories:' || chr(10) || string_agg(r || '. ' || trim(replace(replace(text, chr(10), ' '), chr(13), ' '), {_TRIM}), chr(10) order by r) as block from r""")
def recall_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    top = retrieval.rank(retrieval.truncate(retrieval.vector_scores(question(spark, sf_dir).where("query_id = 0"), m), 5)).join(m.select("pos", "text"), "pos")
    rows = top.agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("r"))
    return rows.select(hooks.recall_lines(F.col("r.text")).alias("block"))


def _stream(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    """``events`` replayed through the file source."""
    events = table(spark, sf_dir, "events")
    reader = spark.readStream.schema(events.schema)
    # The file source lists folders; a table of one file is found by its name in the folder above.
    alone = any(f.endswith("/events.parquet") for f in events.inputFiles()[:1])
    rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else reader.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr(*columns.split("; "))


def _drain(df: DataFrame) -> DataFrame:
    """:func:`drain` with the state store that the stateful operators need."""
    spark = df.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drain(df)
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


@query(f"with {EDGES} select * from m")
def streaming_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "cast(user_id as string) as session; unix_micros(cast(ts as timestamp)) as step; event_id as tie; event_type as item")
    return _drain(jobs.online_transitions(s)).groupBy("prev", "next").agg(F.count("*").alias("cnt"))


@query()
def streaming_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "cast(user_id % 10 as string) as workspace; event_id; 'Shell' as tool; concat('run ', event_type, ' --user ', user_id) as command")
    return _drain(jobs.track(s))
