"""More queries with SQL: readers and sinks by round trip, the store, limits, hooks, and the life of skills."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memtide import catalog as C
from memtide.catalog import query, table
from memtide.engine import MemoryEngine
from memtide.functions import hooks, lifecycle
from memtide.functions.redact import redact_messages
from memtide.operators import filtering, markov, metrics, prototypes, retrieval, skills
from memtide.plans.lineage import shared_folder
from memtide.plans.ranks import numbered
from memtide.sources import readers, schemas, store
from memtide.sources.embedding import HashEngine


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/memtide/io-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as rows of the memory table; every third has no lifecycle yet."""
    at = F.expr("timestampadd(HOUR, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00')")
    life = F.struct((F.col("doc_id") % 3).cast("double").alias("importance"), (F.col("doc_id") % 7).alias("access_count"), F.lit(None).cast("timestamp_ntz").alias("last_accessed_at"), at.alias("created_at"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("boolean").alias("stale"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.array(F.lit(1.0)).alias("embedding"), at.alias("created_at"), F.lit(None).cast(schemas.MESSAGE).alias("source"), F.when(F.col("doc_id") % 3 != 0, life).alias("lifecycle"), F.lit(None).cast("map<string,string>").alias("metadata"))


# Sources and sinks


@query("select 'e' || event_id as id, event_type as name from events where event_id % 7 <> 0 and event_id % 3 <> 0")
def skill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills as JSON lines, every seventh cut off, read back: broken lines and deprecated skills are left out."""
    n = F.col("event_id")
    line = F.to_json(F.struct(F.concat(F.lit("e"), n.cast("string")).alias("id"), F.col("event_type").alias("name"), (n % 3 == 0).alias("deprecated")))
    path = folder(spark)
    table(spark, sf_dir, "events").select(F.when(n % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return readers.skills_jsonl(spark, path, active_only=True).select("id", "name")


@query("""
with r as (select conv_id % 8 as bucket, role, text, row_number() over (partition by conv_id % 8 order by conv_id desc, turn desc) as back from conversations where role in ('user', 'assistant') and text <> '')
select bucket, -cast(back as int) as n, role, text as content from r where back <= 2""")
def transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSONL transcripts, some items wrapped and some lines broken; the last two messages of each."""
    part = F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), F.col("text")))
    message = F.struct(F.lit("message").alias("type"), "role", part.alias("content"))
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.lit("response_item").alias("type"), message.alias("payload")))).otherwise(F.to_json(message))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("bucket"), "conv_id", "turn", F.concat(line, F.when(F.col("turn") == 1, F.lit("\n{broken")).otherwise(F.lit(""))).alias("value"))
    path = folder(spark)
    rows.repartition(8, "bucket").sortWithinPartitions("bucket", "conv_id", "turn").drop("conv_id", "turn").write.partitionBy("bucket").text(path)
    found = readers.transcript(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"), "n", "role", "content")


@query("select 'q' || conv_id as question_id, 's' || conv_id as session_id, cast(turn as int) as turn, role, text as content from conversations")
def haystack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a retrieval benchmark's samples, one JSON object a line, back to a row a turn."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    samples = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    name = lambda c: F.concat(F.lit(c), F.col("conv_id").cast("string"))
    path = folder(spark)
    samples.select(name("q").alias("question_id"), F.array(name("s")).alias("haystack_session_ids"), F.array("t").alias("haystack_sessions")).write.json(path)
    return readers.haystack_turns(spark.read.schema(schemas.LONGMEMEVAL).json(path))


@query("""
select case when grouping(lang) = 1 then 'overall' else 'by_type' end as scope, lang, count(*) as n, round(avg(quality), 4) as recall_at_k, round(avg(toxic), 4) as qa_accuracy
from documents join labels using (doc_id) group by grouping sets ((), (lang))""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics report as JSON, read back."""
    path = folder(spark)
    metrics.write_report(C.grouped_metrics(spark, sf_dir), path)
    return spark.read.schema("scope string, lang string, n bigint, recall_at_k double, qa_accuracy double").json(path)


@query("""
select * from (select 'stored' as step, count(*) as memories, 0.25::double as capacity_usage, 1 as checkpoints from documents) union all select 'forgotten', 0, 0.0::double, 1
union all select 'restored', count(*), 0.25::double, 1 from documents""")
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the store as it is written, forgotten and restored from a named checkpoint."""
    tables = store.Store(spark, folder(spark))
    tables.write("memories", stored(spark, sf_dir))
    tables.write("prototypes", spark.range(4).select(F.col("id").cast("int").alias("proto_id"), F.array(F.when(F.col("id") == 0, 1.0).otherwise(0.01)).alias("vec"), F.lit(1.0).alias("strength"), F.lit(0).cast("bigint").alias("access_count"), F.lit(0).alias("created_step"), F.lit(0).alias("last_access_step")))
    tables.checkpoint("one")
    rows = [("stored", tables.status())]
    tables.forget()
    rows.append(("forgotten", tables.status()))
    tables.restore("one")
    rows.append(("restored", tables.status()))
    return spark.createDataFrame([(step, s["memory_count"], s["capacity_usage"], len(s["checkpoints"])) for step, s in rows], "step string, memories bigint, capacity_usage double, checkpoints int")


@query("""
with a as (select doc_id as pos, text, doc_id as born, 0 as src from documents where lang in ('en', 'fr') union all select doc_id, text, doc_id, 1 from documents),
r as (select *, row_number() over (partition by text, born order by src) as r from a),
k as (select * from r where r = 1)
select sha256(text) as content_hash, row_number() over (order by src, pos) - 1 as place from k""")
def store_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges into the store, the second with rows that are there; the order of the positions."""
    tables, rows = store.Store(spark, folder(spark)), stored(spark, sf_dir)
    n = rows.count()
    lang = table(spark, sf_dir, "documents").where("lang in ('en', 'fr')").select(F.col("doc_id").alias("pos"))
    tables.merge(rows.join(lang, "pos", "left_semi").select(*rows.columns), most=n)
    tables.merge(rows, most=n)
    return numbered(tables.read("memories").select("text", "pos"), "place", "pos").select(F.sha2("text", 256).alias("content_hash"), "place")


@query("""
select count(*) as memory_count, string_agg(r || '. ' || t, chr(10) order by r) as listing, count(*) > 200 as organize
from (select row_number() over (order by item_id) as r, text as t from benchmark)""")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered listing, and whether it asks to be condensed."""
    engine = MemoryEngine(spark, folder(spark), HashEngine)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text", F.array(F.lit(1.0)).alias("embedding"), F.lit(1.0).alias("importance"))
    engine.tables.merge(engine._full(items, None).withColumn("created_at", F.expr("timestampadd(HOUR, cast(pos as int), timestamp_ntz'2024-01-01 00:00:00')")), most=1_000_000)
    return engine.listing().select(F.col("memory_count").cast("bigint").alias("memory_count"), "listing", "organize")


# Limits and lifecycles


@query("select doc_id, length(text) <= 1000 as text_ok, doc_id % 5 <> 0 and doc_id % 7 - 3 >= 0 as importance_ok from documents")
def row_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("doc_id") % 7 - 3)
    return table(spark, sf_dir, "documents").select("doc_id", filtering.valid_text(F.col("text"), 1000).alias("text_ok"), filtering.valid_importance(value).alias("importance_ok"))


@query("""
select doc_id as pos, case when doc_id % 3 = 0 then 1.0 else doc_id % 3 end::double as importance, case when doc_id % 3 = 0 then 0 else doc_id % 7 end as access_count,
  timestamp '2024-01-01' + to_hours(doc_id) as created_at, sha256(text) as content_hash, false as stale from documents""")
def lifecycle_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lifecycle.with_lifecycle(stored(spark, sf_dir))
    return full.select("pos", *(F.col(f"lifecycle.{c}").alias(c) for c in ("importance", "access_count", "created_at", "content_hash", "stale")))


@query("""
select doc_id as pos, case when doc_id % 3 = 0 then 0 else doc_id % 7 end + (doc_id % 4 = 0)::int as access_count, case when doc_id % 4 = 0 then timestamp '2024-03-01' end as last_accessed_at from documents""")
def touched_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.with_lifecycle(stored(spark, sf_dir))
    ids = rows.where("pos % 4 = 0").select("pos")
    return lifecycle.touch(rows, ids.unionByName(ids), F.expr(C.NOW)).select("pos", "lifecycle.access_count", "lifecycle.last_accessed_at")


@query("""
select doc_id as pos, case when doc_id % 3 = 0 then 0 else doc_id % 7 end + (doc_id % 4 = 0)::int + (doc_id % 6 = 0)::int + (doc_id % 10 = 0)::int as access_count,
  case when doc_id % 10 = 0 then timestamp '2024-01-15' when doc_id % 6 = 0 then timestamp '2024-02-02' when doc_id % 4 = 0 then timestamp '2024-02-01' end as last_accessed_at from documents""")
def touched_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls that touch memories of a store, read back; the last is dated before the others, and a merge comes between."""
    tables, rows = store.Store(spark, folder(spark)), lifecycle.with_lifecycle(stored(spark, sf_dir))
    tables.write("memories", rows)
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    ids = rows.where("pos % 4 = 0").select("pos")
    tables.touch(ids.unionByName(ids), at("2024-02-01"))
    tables.touch(rows.where("pos % 6 = 0").select("pos").unionByName(spark.sql("select -1L as pos union all select null")), at("2024-02-02"))
    tables.commit(lambda read: {"memories": read("memories")})
    tables.touch(rows.where("pos % 10 = 0").select("pos"), at("2024-01-15"))
    return tables.read("memories").select("pos", "lifecycle.access_count", "lifecycle.last_accessed_at")


@query("select avg((sqrt(list_dot_product(v, v)) * (vec_id % 8) / 50 > 0.03)::int) as capacity_usage from (select vec_id, embedding::double[] as v from embeddings)")
def prototype_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 8) / 50)
    return prototypes.capacity_usage(table(spark, sf_dir, "embeddings").select(vec.alias("vec")))


# Recall limits


@query(C._recall_sql("r * (1 + 0.3 * l1)", 5, 0.9).replace("as r from f) where r <= 50", "as r from f where score >= 0.4) where r <= 50"))
def recall_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the default recall, of what fuses to 0.4 or more."""
    return retrieval.recall(C.question(spark, sf_dir), C.memories(spark, sf_dir), C.life(), retrieval.RecallConfig(min_score=0.4))


_BARE = f"trim(replace(replace(text, chr(10), ' '), chr(13), ' '), {C._TRIM})"


@query(f"""
with {C.MEM}, s as (select query_id, pos, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, pos) as rank from vec),
t as (select query_id, rank, score, {_BARE} as t, row_number() over (partition by query_id order by rank) as k from s join mem using (pos) where rank <= 10 and score > 0.3)
select q.query_id, coalesce('Relevant memories:' || chr(10) || string_agg(k || '. ' || t, chr(10) order by k), '') as block from q left join t using (query_id) group by q.query_id""")
def recall_above_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of recalled texts that a hook injects; what scores no more than the cutoff stays out."""
    q, m = C.question(spark, sf_dir), C.memories(spark, sf_dir)
    top = retrieval.rank(retrieval.vector_top(q, m, 10)).withColumn("score", F.round("score", 6))
    return hooks.recall_block(top.join(m.select("pos", "text"), "pos"), cutoff=0.3)


# Hooks


@query("""
with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations),
l as (select conv_id, count(*) as n, max(case when role = 'assistant' then text end) as said, count(*) filter (where role = 'assistant') as k from r where r <= 2 and role in ('user', 'assistant') and text <> '' group by conv_id),
c as (select distinct conv_id from conversations)
select conv_id, coalesce(n, 0) + case conv_id % 3 when 0 then 1 when 1 then 0 else 0 end as n from c left join l using (conv_id)""")
def with_last_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's last assistant message is appended unless it is empty or there: new for every third, empty for the next,
    and the one that is there for the others."""
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    e = m.select("conv_id", F.transform(hooks.last_exchange(F.col("m")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("e"))
    there = F.get(F.filter("e", lambda x: x["role"] == "assistant"), 0)["content"]
    said = F.when(F.col("conv_id") % 3 == 0, F.lit("said at the very end")).when(F.col("conv_id") % 3 == 1, F.lit("")).otherwise(F.coalesce(there, F.lit("")))
    return e.select("conv_id", F.size(hooks.with_last_assistant(F.col("e"), said)).cast("bigint").alias("n"))


@query(f"select conv_id, turn, sha256({C._redact_sql('text')}) as redacted_sha256 from conversations")
def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))).alias("m"))
    return m.select("conv_id", F.inline(redact_messages(F.col("m")))).select("conv_id", "turn", F.sha2("content", 256).alias("redacted_sha256"))


@query("""
select event_id, case when event_id % 3 = 0 then 'go ' || event_type when event_id % 3 = 1 then '{"a":"' || event_type || '","z":' || user_id || '}' else 'plain ' || user_id end as command from events""")
def tool_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    given = F.when(n % 3 == 0, F.concat(F.lit('{"command": "go '), kind, F.lit('", "x": 1}'))).when(n % 3 == 1, F.concat(F.lit('{"z": '), user, F.lit(', "a": "'), kind, F.lit('"}'))).otherwise(F.concat(F.lit("plain "), user))
    return table(spark, sf_dir, "events").select("event_id", hooks.tool_command(F.when(n % 3 == 0, "Shell").otherwise("Read"), given).alias("command"))


@query(f"select doc_id, sha256('[Project Context from ' || source || ']' || chr(10) || trim(text, {C._TRIM})) as memory_sha256 from documents")
def context_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(hooks.context_memory(F.col("source"), F.col("text")), 256).alias("memory_sha256"))


@query("""
select d.doc_id, contains(lower(trim(d.text)), lower(trim(b.text))) or contains(lower(trim(b.text)), lower(trim(d.text))) as judged
from documents d join benchmark b on d.doc_id % (select count(*) from benchmark) = b.item_id""")
def contains_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    items = b.select("item_id", F.col("text").alias("expected"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % b.count()).alias("item_id")).join(items, "item_id")
    return rows.select("doc_id", metrics.contains_judge(F.col("text"), F.col("expected")).alias("judged"))


# Transitions


@query(f"with {C.EDGES} select * from m")
def prediction_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default policy fed with two halves of the sessions, one after the other."""
    policy, rows = markov.FirstOrder(4), C.steps(spark, sf_dir)
    edges = policy.reset(markov.transitions(rows))
    for half in (0, 1):
        edges = policy.update(edges, rows.where(F.col("session") % 2 == half))
    return edges


@query(f"""
with {C.EDGES}, g as (select prev, arg_max(next, (cnt, next)) as x from m group by prev), t as (select prev, sum(cnt) as total from m group by prev),
b as (select prev, next as guess from (select *, row_number() over (partition by prev order by cnt desc, next) as r from m) where r = 1)
select round(avg((e.next = b.guess)::int), 6) as top1, round(avg(1 - (m.cnt + 1) / (t.total + 5)), 6) as mean_surprise
from e join m on e.prev = m.prev and e.next = m.next join t on e.prev = t.prev join b on e.prev = b.prev where e.prev is not null""")
def prediction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 accuracy and mean surprise of the transitions that the counts were made of."""
    rows = C.steps(spark, sf_dir)
    prev = F.lag("item").over(Window.partitionBy("session").orderBy("step"))
    pairs = rows.select(prev.alias("prev"), F.col("item").alias("next")).where("prev is not null")
    out = metrics.prediction_suite(markov.transitions(rows), pairs, 5)
    return out.select(F.round("top1", 6).alias("top1"), F.round("mean_surprise", 6).alias("mean_surprise"))


# Skills

FOUND = """found as (
  select workspace, cluster_key, count(*) as n, 'run ' || min(event_type) || case when min(event_id) % 2 = 0 then ' {var}' else '' end as template, 'run ' || min(event_type) as fixed_part,
    0.4 + (count(*) % 50) / 100.0 as fixed_ratio, cast((min(event_id) + 1) % 2 as int) as variable_count from k group by workspace, cluster_key)"""


def found_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons as they might be, from counts of the events."""
    kind, first = F.min("event_type"), F.min("event_id")
    rows = C.keyed(spark, sf_dir).groupBy("workspace", "cluster_key").agg(F.count("*").alias("n"), kind.alias("t"), first.alias("e"))
    slot = F.when(F.col("e") % 2 == 0, " {var}").otherwise("")
    return rows.select("workspace", "cluster_key", "n", F.concat(F.lit("run "), "t", slot).alias("template"), F.concat(F.lit("run "), "t").alias("fixed_part"), (0.4 + (F.col("n") % 50) / 100.0).alias("fixed_ratio"), ((F.col("e") + 1) % 2).cast("int").alias("variable_count"))


@query(f"""
with {C.CMD}, {FOUND}, f as (select *, case when n < 5 then 0 else greatest(0, n - 5) * length(fixed_part) * fixed_ratio end as frustration from found)
select workspace, cluster_key, round(frustration, 6) as frustration, row_number() over (order by round(frustration, 6) desc, cluster_key, workspace) as place from f where fixed_ratio >= 0.6 and frustration >= 50""")
def ready_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that are ready, the most frustrating first."""
    ready = skills.ready_clusters(found_clusters(spark, sf_dir)).withColumn("frustration", F.round("frustration", 6))
    w = Window.orderBy(F.col("frustration").desc(), "cluster_key", "workspace")  # a row a cluster
    return ready.select("workspace", "cluster_key", "frustration", F.row_number().over(w).alias("place"))


@query(f"""
with {C.CMD}, {FOUND}, f as (select *, variable_count = 0 as is_alias from found where fixed_ratio >= 0.6 and n >= 5 and (n - 5) * length(fixed_part) * fixed_ratio >= 50)
select (case when is_alias then 'alias' else 'workflow' end) || '_' || substr(sha256(workspace || chr(10) || cluster_key), 1, 12) as id, case when is_alias then 'alias' else 'workflow' end as type, cluster_key as name,
  template as trigger_pattern, case when is_alias then template end as expansion, case when not is_alias then template end as template, round(fixed_ratio, 6) as confidence, 1 as version, false as deprecated from f""")
def extracted_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = skills.extract_skills(skills.ready_clusters(found_clusters(spark, sf_dir)), F.lit("2024-03-01"))
    return new.select("id", "type", "name", "trigger_pattern", "expansion", "template", F.round("confidence", 6).alias("confidence"), "version", "deprecated")


@query(f"""
with {C.CMD}, {FOUND}, o as (select * from found where workspace = '1'), s as (select 'skill-' || cluster_key as id, cluster_key as name, case when n % 2 = 0 then template else 'run other' end as old, n, template, fixed_ratio from o)
select id || '_v3' as id, name, template as trigger_pattern, round(fixed_ratio, 6) as confidence, 0 as usage_count, 3 as version from s where n >= 5 and template <> old""")
def revised_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills whose cluster has another template by now, as new versions."""
    now = found_clusters(spark, sf_dir).where("workspace = '1'")
    old = F.when(F.col("n") % 2 == 0, F.col("template")).otherwise("run other")
    known = now.select(F.concat(F.lit("skill-"), "cluster_key").alias("id"), F.lit("workflow").alias("type"), F.col("cluster_key").alias("name"), old.alias("trigger_pattern"), F.lit(None).cast("string").alias("expansion"), old.alias("template"), F.lit(0.9).alias("confidence"), F.lit(7).alias("usage_count"), F.lit(1).alias("failure_count"), F.lit(2).alias("version"), F.lit(False).alias("deprecated"))
    return skills.revise(known, now).select("id", "name", "trigger_pattern", F.round("confidence", 6).alias("confidence"), "usage_count", "version")


VERBS = ("ls -la", "git status", "git push", "cat notes", "rm notes")


@query("""
select event_id, event_type <> 'error' as ok, case event_id % 5 when 0 then 'list' when 1 then 'git' when 3 then 'read' end as skill_id from events
where event_id % 4 <> 0 and event_id % 5 in (0, 1, 3) and event_id % 9 <> 0""")
def validated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of safe commands with a known result, by the skill that they fit."""
    n = F.col("event_id")
    command = F.get(F.array(*map(F.lit, VERBS)), (n % len(VERBS)).cast("int"))
    events = table(spark, sf_dir, "events").select("event_id", F.when(n % 4 == 0, "Read").otherwise("Shell").alias("tool"), command.alias("command"), F.when(n % 9 != 0, F.col("event_type") != "error").alias("ok"))
    known = spark.createDataFrame([("list", 0, "ls {x}", False), ("git", 1, "git {x}", False), ("old", 2, "cat {x}", True), ("read", 3, "cat notes", False), ("late", 4, "cat {x}", False)], "id string, position int, template string, deprecated boolean").withColumn("expansion", F.lit(None).cast("string"))
    return skills.validate(events, known).select("event_id", "ok", "skill_id")


@query(r"""
with t as (select conv_id, turn, unnest(regexp_split_to_array(text, '\s+')) as token from conversations)
select token, count(*) as n, regexp_full_match(token, '[0-9a-fA-F-]{4,}|[0-9]+') or contains(token, '/') or contains(token, '\') as variable from t where token <> '' group by token""")
def variable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    return t.groupBy("token").agg(F.count("*").alias("n")).select("token", "n", skills.looks_variable(F.col("token")).alias("variable"))


@query("""
with s as (select user_id, 0.8 + 0.2 * avg((event_type = 'click')::int) as c, count(*) as u, max(ts) as t, bool_or(user_id % 4 = 0) as alias from events group by user_id),
f as (select *, row_number() over (order by c * (1 + u) desc, t desc, cast(user_id as varchar)) as r from s),
l as (select r, '- `' || 'use ' || '''' || user_id || '` = `' || case when alias then 'go ' else 'walk ' end || user_id || '`' as line from f where r <= 10)
select '## Your active shortcuts' || chr(10) || chr(10) || string_agg(line, chr(10) order by r) || chr(10) as formatted from l""")
def formatted_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of active skills for an agent's context."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg((0.8 + 0.2 * F.avg((F.col("event_type") == "click").cast("int"))).alias("confidence"), F.count("*").alias("usage_count"), F.max("ts").cast("string").alias("last_used"))
    alias = F.col("id").cast("int") % 4 == 0
    known = e.select("*", F.concat(F.lit("use `"), "id").alias("name"), F.when(alias, "alias").otherwise("workflow").alias("type"), F.when(alias, F.concat(F.lit("go "), "id")).alias("expansion"), F.when(~alias, F.concat(F.lit("walk "), "id")).alias("template"), F.lit(False).alias("deprecated"))
    return skills.format_skills(skills.select_skills(known, 0.0, 10))


QUERIES, ORACLES = C.QUERIES, C.ORACLES


# Learning over calls


CALLS = 5


def _calls_sql() -> str:
    said = f"with recursive {C.PROTO}, pr0 as (select proto_id, vec, 0::bigint as n, 1.0::double as s from pr)"
    for b in range(CALLS):
        said += f""",
a{b} as materialized (select id, e, arg_max(proto_id, (round(sim, 12), -proto_id)) as proto_id from (select v.id, v.e, p.proto_id, list_cosine_similarity(v.e, p.vec) as sim from v, pr{b} p where v.id % {CALLS} = {b}) group by id, e),
o{b} as materialized (select proto_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e, row_number() over (partition by proto_id order by id) as i from a{b}),
f{b} as (
  select proto_id, 0::bigint as i, vec as v, n, s from pr{b}
  union all
  select proto_id, i, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))), n + 1, least(s + 1 / (1 + 0.2 * n), 5.0) from (
    select f.proto_id, o.i, f.n, f.s, list_transform(range(1, len(f.v) + 1), lambda d: f.v[d] + 0.1 / (1 + 0.01 * f.n) * list_dot_product(f.v, o.e) * (o.e[d] - list_dot_product(f.v, o.e) * f.v[d])) as raw
    from f{b} f join o{b} o on o.proto_id = f.proto_id and o.i = f.i + 1)),
pr{b + 1} as materialized (select proto_id, list_transform(arg_max(v, i), lambda x: 0.995 * x) as vec, max(n) as n, 0.995 * arg_max(s, i) as s from f{b} group by proto_id)"""
    hits = " union all ".join(f"select {b} as b, id, proto_id from a{b}" for b in range(CALLS))
    return said + f""",
hit as ({hits}), edge as (select lag(proto_id) over (order by b, id) as prev, proto_id as next from hit)
select 'vec' as kind, proto_id::bigint as a, d::bigint as b, round(x, 6) as value from (select proto_id, unnest(vec) as x, unnest(range(len(vec))) as d from pr{CALLS})
union all select 'count', proto_id, 0, n from pr{CALLS} union all select 'strength', proto_id, 0, round(s, 6) from pr{CALLS}
union all select 'edge', prev, next, count(*) from edge where prev is not null group by all
union all select 'report', b, count(distinct proto_id), count(*) from hit group by b"""


def _learner(spark: SparkSession, sf_dir: str) -> MemoryEngine:
    engine = MemoryEngine(spark, folder(spark), HashEngine, prediction=markov.FirstOrder(64))
    engine.tables.write("prototypes", C.protos(spark, sf_dir).select("proto_id", F.col("vec").cast("array<double>").alias("vec"), "strength", "access_count", "created_step", "last_access_step"))
    return engine


def _state(engine: MemoryEngine, reports: list[tuple]) -> DataFrame:
    p = engine.tables.read("prototypes")
    row = lambda kind, a, b, value: (F.lit(kind).alias("kind"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), value.cast("double").alias("value"))
    n = F.lit(0)
    vec = p.select("proto_id", F.posexplode("vec").alias("d", "x")).select(*row("vec", F.col("proto_id"), F.col("d"), F.round("x", 6)))
    edges = engine.tables.read("transitions").select(*row("edge", F.col("prev"), F.col("next"), F.col("cnt")))
    told = engine.spark.createDataFrame(reports, "step long, hit long, n long").select(*row("report", F.col("step"), F.col("hit"), F.col("n")))
    return vec.unionByName(p.select(*row("count", F.col("proto_id"), n, F.col("access_count")))).unionByName(p.select(*row("strength", F.col("proto_id"), n, F.round("strength", 6)))).unionByName(edges).unionByName(told)


@query(_calls_sql())
def learning_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five learn calls over all embeddings: prototypes, the chain of transitions over the calls, and the reports."""
    engine, e = _learner(spark, sf_dir), C.vectors(spark, sf_dir)
    reports = [engine.learn(e.where(F.col("id") % CALLS == b)).first() for b in range(CALLS)]
    return _state(engine, [(r["step"], r["unique_updated"], r["updated"]) for r in reports])


@query(_calls_sql())
def streaming_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of five files, a micro-batch each, as a subscriber hears of it."""
    engine, e, path = _learner(spark, sf_dir), C.vectors(spark, sf_dir), folder(spark)
    reports = []
    engine.subscribe(lambda event: reports.append((event["step"], event["report"]["unique_updated"], event["report"]["updated"])))
    for b in range(CALLS):
        e.where(F.col("id") % CALLS == b).coalesce(1).write.parquet(f"{path}/in/{b}")
    stream = spark.readStream.schema("id bigint, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    engine.learn_stream(stream).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return _state(engine, reports)
