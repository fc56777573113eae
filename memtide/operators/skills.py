"""Skill mining: clusters of repeated commands, their templates, and the life of skills."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import accumulate, chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memtide.plans.lineage import cut

#: Commands that only read, and the reading subcommands of git.
SAFE_VERBS = ("cat", "ls", "find", "grep", "rg", "head", "tail", "wc", "sort", "uniq", "diff", "stat", "echo", "pwd", "which", "git")
SAFE_GIT = ("status", "log", "show", "branch", "remote", "diff", "ls-files", "ls-tree")

SKELETON_SCHEMA = "cluster_key string, n bigint, template string, fixed_part string, fixed_ratio double, variable_count int"


def command_tokens(command: Column) -> Column:
    return F.filter(F.split(command, r"(?U)\s+"), lambda t: t != "")


def cluster_key(tool: Column, command: Column) -> Column:
    """Shell commands by their first word and, unless it is an option, their second; other tools by name."""
    t = command_tokens(command)
    shell = F.when(F.size(t) == 0, "Shell:<empty>").when((F.size(t) >= 2) & ~F.startswith(F.get(t, 1), F.lit("-")), F.concat(F.lit("Shell:"), F.get(t, 0), F.lit(" "), F.get(t, 1))).otherwise(F.concat(F.lit("Shell:"), F.get(t, 0)))
    return F.when(tool == "Shell", shell).otherwise(F.concat(F.lit("Tool:"), tool))


def is_safe(tool: Column, command: Column) -> Column:
    t = command_tokens(command)
    verb = F.lower(F.get(t, 0))
    git = F.coalesce(F.lower(F.get(t, 1)).isin(*SAFE_GIT), F.lit(False))
    return F.when((tool != "Shell") | (F.size(t) == 0), F.lit(False)).when(verb == "git", git).otherwise(verb.isin(*SAFE_VERBS))


def looks_variable(token: Column) -> Column:
    """Hexadecimal with dashes of four or more, digits, or a path."""
    return token.rlike(r"\A[0-9a-fA-F-]{4,}\z") | token.rlike(r"\A\d+\z") | token.rlike(r"[/\\]")


_variable = re.compile(r"[0-9a-fA-F-]{4,}|\d+|.*[/\\].*", re.DOTALL).fullmatch


def _literal(words: list[str], others: Iterable[list[str]]) -> set[int]:
    """Places of ``words`` that lie in a matching block with every one of ``others``."""
    places = set(range(len(words)))
    for other in others:
        blocks = SequenceMatcher(None, words, other).get_matching_blocks()
        places.intersection_update(chain.from_iterable(range(b.a, b.a + b.size) for b in blocks))
    return places


def skeleton(commands: list[str]) -> tuple[str, str, float, int]:
    """Template, its literal part, the literal share of the mean length, and the number of slots.

    Literal are the words of the first command that all others share; a run of other words is a slot, numbered from the
    second on, with the name of its first word, or ``var`` for a word that looks like a value. One command is all literal.
    """
    if len(commands) < 2:
        only = "".join(commands)
        return only, only, float(len(commands)), 0
    words = commands[0].split()
    literal = _literal(words, {tuple(c.split()): c.split() for c in commands[1:]}.values())
    runs = [(fixed, [words[i] for i in places]) for fixed, places in groupby(range(len(words)), literal.__contains__)]
    slots = accumulate(not fixed for fixed, _ in runs)
    names = ["var" if _variable(run[0]) else run[0] for _, run in runs]
    told = [" ".join(run) if fixed else f"{{{name}{slot if slot > 1 else ''}}}" for (fixed, run), name, slot in zip(runs, names, slots, strict=True)]
    constant = " ".join(" ".join(run) for fixed, run in runs if fixed)
    length = sum(map(len, commands))
    return " ".join(told), constant, len(constant) * len(commands) / length if length else 0.0, sum(not fixed for fixed, _ in runs)


def skeletons(commands: DataFrame, window: int = 50) -> DataFrame:
    """``([workspace,] cluster_key, event_id, command)`` -> one skeleton per workspace and cluster over its last ``window``
    events."""
    keys = [c for c in ("workspace", "cluster_key") if c in commands.columns]
    w = Window.partitionBy(*keys).orderBy(F.col("event_id").desc())
    last = commands.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= window)  # bounds every group
    names = [*keys, "n", "template", "fixed_part", "fixed_ratio", "variable_count"]

    def of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("event_id")["command"].tolist()
        return pd.DataFrame([(*key, len(ordered), *skeleton(ordered))], columns=names)

    schema = ", ".join([*(f"{k} string" for k in keys if k != "cluster_key"), SKELETON_SCHEMA])
    return last.select(*keys, "event_id", "command").groupBy(*keys).applyInPandas(of, schema)


def frustration(n: Column, fixed_part: Column, fixed_ratio: Column, min_repetitions: int = 5) -> Column:
    """Repetitions beyond the least, times the literal length, times its share; 0 below the least."""
    return F.when(n < min_repetitions, F.lit(0.0)).otherwise(F.greatest(F.lit(0), n - min_repetitions) * F.length(fixed_part) * fixed_ratio)


def windowed_counts(events: DataFrame, size: int = 50, by: str = "workspace") -> DataFrame:
    """For each event, how many of the last ``size`` events of its workspace, itself included, are of its cluster."""
    place = events.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy("event_id")))
    w = Window.partitionBy(by, "cluster_key").orderBy("_p").rangeBetween(-(size - 1), 0)
    return place.withColumn("repeat_count", F.count("*").over(w)).drop("_p")


def ready_clusters(found: DataFrame, min_ratio: float = 0.6, threshold: float = 50.0) -> DataFrame:
    scored = found.withColumn("frustration", frustration(F.col("n"), F.col("fixed_part"), F.col("fixed_ratio")))
    return scored.where((F.col("fixed_ratio") >= min_ratio) & (F.col("frustration") >= threshold)).orderBy(F.col("frustration").desc(), "cluster_key")


def extract_skills(ready: DataFrame, now: Column) -> DataFrame:
    """Skeletons -> new skills, keyed by workspace, if there is one, cluster and version."""
    named = F.concat_ws("\n", *(c for c in ("workspace", "cluster_key") if c in ready.columns))
    alias = F.col("variable_count") == 0
    kind = F.when(alias, "alias").otherwise("workflow")
    return ready.select(
        F.concat_ws("_", kind, F.sha2(named, 256).substr(1, 12)).alias("id"), kind.alias("type"), F.col("cluster_key").alias("name"), F.col("template").alias("trigger_pattern"),
        F.when(alias, F.col("template")).alias("expansion"), F.when(~alias, F.col("template")).alias("template"), F.array().cast("array<string>").alias("required_context"), F.col("fixed_ratio").alias("confidence"),
        F.lit(0).alias("usage_count"), F.lit(0).alias("failure_count"), F.lit(1).alias("version"), F.lit(False).alias("deprecated"), now.cast("string").alias("created_at"), F.lit("").alias("last_used"),
    )


def template_regex(template: Column) -> Column:
    """``{..}`` words match one word, all others themselves, with white space between; anchored at the start."""
    part = lambda t: F.when(t.rlike(r"\A\{.*\}\z"), F.lit(r"\S+")).otherwise(F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"\A\s*"), F.array_join(F.transform(command_tokens(template), part), r"\s+"), F.lit(r"\s*\z"))


#: Templates, and shapes of templates, that are sent to every task; more are shuffled.
MAX_TEMPLATES = 1_000_000


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(MAX_TEMPLATES + 1).count() <= MAX_TEMPLATES else table


def match_templates(commands: DataFrame, skills: DataFrame) -> DataFrame:
    """Each command with the first skill, in store order, whose template it fits.

    A template's shape says which of its words are slots. A command is looked up once for each shape of as many words, by
    the words that stand where the shape has none, so no template is tried that does not fit. ``_`` is a word, ``*`` a slot.
    """
    slot = lambda t: t.rlike(r"\A\{.*\}\z")
    t = skills.where(~F.col("deprecated")).select("id", "position", command_tokens(F.coalesce("template", "expansion")).alias("t")).where("t is not null")
    t = t.select("id", "position", F.array_join(F.transform("t", lambda x: F.when(slot(x), "*").otherwise("_")), "").alias("shape"), F.filter("t", lambda x: ~slot(x)).alias("words"))
    t = cut(t.groupBy("shape", "words").agg(F.min_by(F.struct("position", "id"), "position").alias("first")))
    shapes = t.select("shape", F.length("shape").alias("n")).distinct()
    told = commands.select("event_id", F.filter(F.split("command", r"\s+"), lambda x: x != "").alias("_w")).withColumn("n", F.size("_w"))
    keyed = told.join(_few(shapes), "n").select("event_id", "shape", F.filter("_w", lambda x, i: F.substring(F.col("shape"), i + 1, F.lit(1)) == "_").alias("words"))
    first = keyed.join(_few(t), ["shape", "words"]).groupBy("event_id").agg(F.min("first").alias("first"))
    return commands.join(first, "event_id", "left").select(*commands.columns, F.col("first.id").alias("skill_id"))


FOLDED = "confidence double, usage_count int, failure_count int, deprecated boolean"


def confidence_fold(outcomes: DataFrame, start: float | DataFrame = 0.8) -> DataFrame:
    """``(skill_id, event_id, ok)`` -> confidence and counters after all outcomes in order, and whether the skill ends.

    ``start`` is a confidence, or a table ``(id, confidence, usage_count, failure_count)`` to go on from. Outcomes are
    streamed in order, so a skill with very many takes no more memory than one with few.
    """
    if isinstance(start, DataFrame):
        first = start.select(F.col("id").alias("skill_id"), F.col("confidence").cast("double").alias("c"), F.col("usage_count").cast("int").alias("u"), F.col("failure_count").cast("int").alias("f"))
        rows = outcomes.select("skill_id", "event_id", "ok").join(first, "skill_id")
    else:
        rows = outcomes.select("skill_id", "event_id", "ok", F.lit(float(start)).alias("c"), F.lit(0).alias("u"), F.lit(0).alias("f"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, names = None, None, ["skill_id", *(c.split()[0] for c in FOLDED.split(", "))]
        for frame in frames:
            done = []
            for skill, ok, c, u, f in zip(*(frame[k] for k in ("skill_id", "ok", "c", "u", "f")), strict=True):
                if state is None or skill != now:
                    done += [(now, *state)] if state is not None else []
                    now, state = skill, (c, u, f, False)
                c, u, f, ended = state
                c = min(1.0, 0.9 * c + 0.1) if ok else max(0.0, 0.95 * c - 0.05)
                u, f = u + bool(ok), f + (not ok)
                state = c, u, f, ended or f >= 5 or (u >= 5 and c < 0.5)
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, *state)], columns=names)

    n = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["skill_id"].dataType.simpleString()
    return rows.where("skill_id is not null and ok is not null").repartition(n, "skill_id").sortWithinPartitions("skill_id", "event_id", "ok").mapInPandas(fold, f"skill_id {kind}, {FOLDED}")


def validate(events: DataFrame, skills: DataFrame) -> DataFrame:
    """Outcomes of safe commands with a known result, by the skill they fit: ``(skill_id, event_id, ok)``."""
    safe = events.where(is_safe(F.col("tool"), F.col("command")) & F.col("ok").isNotNull())
    return match_templates(safe, skills).where("skill_id is not null").select("skill_id", "event_id", "ok")


def revise(skills: DataFrame, found: DataFrame, min_repetitions: int = 5) -> DataFrame:
    """New versions of skills whose cluster now has another template."""
    c = found.select(F.col("cluster_key").alias("name"), F.col("template").alias("_t"), F.col("fixed_ratio").alias("_r"), F.col("n").alias("_n"))
    old = F.coalesce(F.nullif(F.col("template"), F.lit("")), F.col("expansion"))
    changed = skills.join(c, "name").where((F.col("_n") >= min_repetitions) & (F.coalesce(old, F.lit("")) != "") & (F.col("_t") != old))
    v = F.col("version") + 1
    new = changed.withColumns({"id": F.concat("id", F.lit("_v"), v.cast("string")), "trigger_pattern": F.col("_t"), "template": F.when(F.col("type") == "workflow", F.col("_t")), "expansion": F.when(F.col("type") == "alias", F.col("_t")), "confidence": F.col("_r"), "usage_count": F.lit(0), "failure_count": F.lit(0), "version": v, "deprecated": F.lit(False)})
    return new.select(*skills.columns)


def select_skills(skills: DataFrame, min_confidence: float = 0.85, most: int = 10) -> DataFrame:
    """Active skills by confidence times use, then by last use; a time that doesn't parse is the earliest."""
    active = skills.where(~F.col("deprecated") & (F.col("confidence") >= min_confidence))
    used = F.coalesce(F.unix_micros(F.try_to_timestamp("last_used")), F.lit(0).cast("bigint"))
    return active.orderBy((F.col("confidence") * (1 + F.col("usage_count"))).desc(), used.desc(), "id").limit(most)


def format_skills(chosen: DataFrame) -> DataFrame:
    """One row ``formatted``: the block that is put into an agent's context; empty without skills."""
    plain = lambda c: F.replace(F.col(c), F.lit("`"), F.lit("'"))
    body = F.when((F.col("type") == "alias") & (F.coalesce("expansion", F.lit("")) != ""), plain("expansion")).when(F.coalesce("template", F.lit("")) != "", plain("template"))
    used = F.coalesce(F.unix_micros(F.try_to_timestamp("last_used")), F.lit(0).cast("bigint"))
    line = F.when(body.isNotNull(), F.concat(F.lit("- `"), plain("name"), F.lit("` = `"), body, F.lit("`")))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("confidence") * (1 + F.col("usage_count"))).alias("k"), (-used).alias("u"), "id", line.alias("l"))))
    lines = F.filter(F.transform(rows, lambda r: r["l"]), lambda x: x.isNotNull())
    whole = F.concat(F.lit("## Your active shortcuts\n\n"), F.array_join(F.concat(lines, F.array(F.lit(""))), "\n"))
    return chosen.agg(F.count("*").alias("n"), whole.alias("w")).select(F.when(F.col("n") == 0, "").otherwise(F.col("w")).alias("formatted"))
