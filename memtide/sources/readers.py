"""Readers. All go through Spark's own sources, so paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memtide.sources import schemas

#: Instruction files of projects, in order of preference.
CONTEXT_FILES = ("AGENTS.md", "CLAUDE.md", ".cursorrules", ".claude.md")


def memories_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of memories; missing lifecycle fields stay null for ``with_lifecycle`` to fill."""
    rows = spark.read.schema(schemas.MEMORY.replace("pos bigint, ", "")).option("multiLine", True).json(path)
    return rows.withColumn("pos", F.monotonically_increasing_id()).where("text is not null")


def skills_jsonl(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    """Skills, a JSON object a line; lines that don't parse, and blank ones, are left out."""
    lines = spark.read.text(path).select(F.from_json("value", schemas.SKILL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("s"))
    rows = lines.where("s.id is not null").select("s.*").withColumn("position", F.monotonically_increasing_id())
    return rows.where(~F.col("deprecated")) if active_only else rows


def skill_by_id(skills: DataFrame, skill_id: str) -> DataFrame:
    return skills.where(F.col("id") == skill_id).limit(1)


def transcript(spark: SparkSession, path: str | Sequence[str], last: int = 2) -> DataFrame:
    """The last messages of each JSONL transcript: ``(path, n, role, content)``, oldest first.

    Wrapped items are unwrapped; only messages of a user or assistant with text count; bad lines are left out.
    """
    item = "type string, role string, content array<struct<type:string,text:string>>"
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.from_json("value", f"{item}, payload struct<{item.replace(' ', ':', 1).replace(', role ', ',role:').replace(', content ', ',content:')}>").alias("j"))
    inner = F.when((F.col("j.type") == "response_item") & F.col("j.payload").isNotNull(), F.col("j.payload")).otherwise(F.struct("j.type", "j.role", "j.content"))
    rows = lines.where("j is not null").select("path", "line", inner.alias("m")).where("m.type = 'message' and m.role in ('user', 'assistant')")
    texts = F.filter("m.content", lambda p: p["type"].isin("input_text", "output_text") & (F.coalesce(p["text"], F.lit("")) != ""))
    rows = rows.select("path", "line", "m.role", F.array_join(F.transform(texts, lambda p: p["text"]), "\n").alias("content")).where("content <> ''")
    newest = Window.partitionBy("path").orderBy(F.col("line").desc())
    rows = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)
    return rows.select("path", (-F.col("back")).alias("n"), "role", "content").orderBy("path", "n")


def context_files(spark: SparkSession, folder: str, names: Sequence[str] = CONTEXT_FILES, max_bytes: int = 100_000) -> DataFrame:
    """Instruction files of one folder, not below it: ``(path, name, content)`` in order of preference.

    Names are compared without case; larger files and bytes that are not UTF-8 are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    known = F.array(*(F.lit(n.lower()) for n in names))
    rows = files.where(F.array_contains(known, F.lower(name)) & (F.col("length") <= max_bytes)).where(F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select("path", name.alias("name"), F.col("content").cast("string").alias("content")).orderBy(F.array_position(known, F.lower("name")), "path")


def longmemeval(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(schemas.LONGMEMEVAL).option("multiLine", True).json(path)
    return rows.limit(limit) if limit else rows


def haystack_turns(samples: DataFrame) -> DataFrame:
    """One row per turn of every session of every sample."""
    sessions = samples.select("question_id", "haystack_session_ids", F.posexplode("haystack_sessions").alias("s", "turns"))
    return sessions.select("question_id", F.get("haystack_session_ids", F.col("s")).alias("session_id"), F.posexplode("turns").alias("turn", "t")).select("question_id", "session_id", "turn", "t.role", "t.content")


#: The sentences of the learning suites, five of each theme.
THEMES = {
    "fruit": ("苹果富含维生素 C", "香蕉是钾的良好来源", "橙子味道酸甜", "葡萄可以直接食用", "草莓是红色的浆果"),
    "code": ("Python 支持异步编程", "Rust 的所有权系统保证内存安全", "函数式编程强调不可变性", "单元测试能提高代码质量", "Docker 容器化简化了部署"),
    "history": ("秦始皇统一了六国", "唐朝是中国古代强盛的朝代", "丝绸之路连接了东西方", "明朝郑和下西洋", "清朝末年发生了鸦片战争"),
}


def theme_corpus(spark: SparkSession) -> DataFrame:
    """A small built-in corpus: ``(theme, id, text)``."""
    rows = [(theme, text) for theme, every in THEMES.items() for text in every]
    return spark.createDataFrame([(theme, i, text) for i, (theme, text) in enumerate(rows)], "theme string, id bigint, text string")


def hook_events(spark: SparkSession, folder: str, max_chars: int = 10 << 20) -> DataFrame:
    """A stream of hook payloads, one JSON object a line: ``(payload, hook_event_name)``; oversized ones are left out."""
    rows = spark.readStream.format("text").load(folder).where(F.length("value") <= max_chars)
    return rows.select(F.col("value").alias("payload"), F.get_json_object("value", "$.hook_event_name").alias("hook_event_name"))
