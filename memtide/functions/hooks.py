"""Hook payloads: what was said, what a tool returned, and how it is shortened for memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memtide.functions.text import strip



def user_text(payload: Column) -> Column:
    """``user_prompt``, a string ``prompt``, the text parts of a list ``prompt``, ``hook_input.content``, ``matcher``."""
    v = F.try_parse_json(payload)
    text = lambda path: F.nullif(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))
    parts = F.from_json(F.get_json_object(payload, "$.prompt"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"]), "\n")
    listed = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.prompt", "variant")), F.lit("ARRAY")), F.nullif(joined, F.lit("")))
    return F.coalesce(text("$.user_prompt"), text("$.prompt"), listed, text("$.hook_input.content"), text("$.matcher"), F.lit(""))


def last_exchange(messages: Column) -> Column:
    """Of the last two messages, cut before they are looked at, those of a user or assistant that say something."""
    tail = F.slice(messages, F.greatest(F.lit(1), F.size(messages) - 1), F.lit(2))
    return F.filter(tail, lambda m: m["role"].isin("user", "assistant") & (F.coalesce(m["content"], F.lit("")) != ""))


def with_last_assistant(exchange: Column, said: Column) -> Column:
    """Appends the payload's last assistant message unless it is there already."""
    there = F.exists(exchange, lambda m: (m["role"] == "assistant") & (m["content"] == said))
    extra = F.array(F.struct(F.lit("assistant").alias("role"), said.alias("content")))
    return F.when((F.coalesce(said, F.lit("")) == "") | there, exchange).otherwise(F.concat(exchange, extra))


def summarize(text: Column, role: Column, max_chars: int = 150) -> Column:
    """Assistant texts become their first sentence, or are cut at a word with an ellipsis; others are only stripped.

    Delimiters are tried in order of preference; the first that occurs past the start decides.
    """
    bare = strip(text)
    short = F.when(F.length(bare) <= max_chars, bare).otherwise(F.concat(F.regexp_replace(F.substring(bare, 1, max_chars), r"(?s)\A(.*) [^ ]*\z", "$1"), F.lit("…")))
    out = None
    for mark in ("\n\n", "。", ". ", "?", "!"):
        at = F.locate(mark, bare)
        first = strip(F.substring(bare, F.lit(1), at + len(mark) - 1))
        found = F.when(F.length(first) <= max_chars, first).otherwise(short)
        out = F.when(at > 1, found) if out is None else out.when(at > 1, found)
    return F.when(role != "assistant", bare).otherwise(out.otherwise(short))


def tool_command(tool: Column, tool_input: Column) -> Column:
    """A shell tool's command; otherwise its input as JSON with sorted keys, or as it is if it doesn't parse."""
    return F.when(tool == "Shell", F.coalesce(F.get_json_object(tool_input, "$.command"), F.lit(""))).otherwise(F.coalesce(F.to_json(F.try_parse_json(tool_input)), tool_input))


def tool_result(payload: Column) -> Column:
    """True, false or null (unknown) from ``tool_result`` as a boolean, an object or a text."""
    v = F.try_variant_get(F.try_parse_json(payload), "$.tool_result", "variant")
    kind = F.schema_of_variant(v)
    get = lambda path, as_type: F.try_variant_get(v, path, as_type)
    failed = kind.rlike(r"[<, ]error: ") | (kind.rlike(r"[<, ]exit_code: ") & ~F.coalesce(get("$.exit_code", "double") == 0, F.lit(False)))
    obj = F.when(failed, F.lit(False)).when(kind.rlike(r"[<, ]success: "), F.coalesce(get("$.success", "boolean"), F.lit(False))).otherwise(F.lit(True))
    said = F.lower(get("$", "string"))
    text = ~(F.startswith(said, F.lit("error:")) | F.startswith(said, F.lit("exception:")) | F.startswith(said, F.lit("failed")))
    return F.when(kind == "BOOLEAN", get("$", "boolean")).when(F.startswith(kind, F.lit("OBJECT")), obj).when(kind == "STRING", text)


def recall_lines(texts: Column) -> Column:
    """An ordered array of recalled texts as numbered lines under a heading; empty without any."""
    one = lambda t: strip(F.translate(t, "\n\r", "  "))
    lines = F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), one(t)))
    return F.when(F.size(texts) == 0, "").otherwise(F.concat(F.lit("Relevant memories:\n"), F.array_join(lines, "\n")))


def recall_block(recalled: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """``(query_id, rank, score, text)`` -> ``(query_id, block)`` of the rows that score above ``cutoff``."""
    rows = F.sort_array(F.collect_list(F.when(F.col("score") > cutoff, F.struct("rank", "text"))))
    return recalled.groupBy("query_id").agg(rows.alias("r")).select("query_id", recall_lines(F.col("r.text")).alias("block"))


def context_memory(name: Column, content: Column) -> Column:
    return F.concat(F.lit("[Project Context from "), name, F.lit("]\n"), strip(content))
