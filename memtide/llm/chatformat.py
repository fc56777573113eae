"""Chat formatting into budgeted windows, on DataFrame operations alone.

Turns are dealt by (conversation, block of turn numbers), so that a conversation of any length is many bounded groups;
a block also gets the ``max_history`` turns before it. In a block, prefix sums of turn tokens choose spans
that begin and end with turns and fit the budget next to the system turn and a little history. Every window is: the system
turn, up to ``max_history`` turns that the window before already had, and new turns. A turn's tokens are the caller's
count, or else its UTF-8 bytes: no byte-level tokenizer makes more tokens of a string than that, so the budget holds for
all of them, at the price of shorter windows. Whatever is repeated is marked as history and stays outside the loss mask, so each assistant turn is
a target once.

A turn is written ``<|turn|>role`` or ``<|hist|>role``, a line feed, the text and ``<|end|>``. Inside roles and texts a
backslash goes before each backslash and after the first character of each control string; leaving backslashes out again
gives the text back. Roles have no line feed after that, as one is written ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of this template and of templates in wide use; ``<|`` begins all of the first kind.
CONTROL = r"<(?=\||/?s>|</?SYS>>|<?/SYS>>|/?(?:think|tool_call|tool_response|start_of_turn|end_of_turn|bos|eos|pad|unk)>)|\[(?=/?(?:INST|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])"
TURN, HISTORY, END = "<|turn|>", "<|hist|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # ``\n`` after an even run of backslashes is a line feed; the two-step form keeps a text's own ``\n`` apart.
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\\\\\n"))


def turn_text(role: Column, text: Column, mark: str = TURN) -> Column:
    """What stands in a window for a turn."""
    return F.concat(F.lit(mark), escape_role(F.coalesce(role, F.lit(""))), F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def windows(turns: DataFrame, budget: int = 2048, history_budget: int = 256, max_history: int = 2, block_turns: int = 1024) -> DataFrame:
    """``(conv_id, turn, role, text[, tokens])`` -> one row per window.

    ``(conv_id, block, window, formatted, loss, n_tokens)``: ``loss`` is an array of ``(start, length)`` in code points of
    ``formatted``. A window's tokens stay within ``budget`` unless its one new turn and the system turn alone are longer.
    ``tokens``, if there is such a column, is the caller's count for :func:`turn_text`; a null and a missing column mean
    its UTF-8 bytes, an upper bound for every byte-level vocabulary.
    The system turn is a first turn (lowest number of the conversation) with that role; it is kept in every window.
    Spans end where a block of ``block_turns`` turn numbers ends; history goes on.
    Null texts and roles are empty; turns that share a number, or have none, are ordered by role and text; null conv_ids
    are one conversation; extra columns are ignored; an empty table gives an empty one.
    """
    counted = F.col("tokens").cast("bigint") if "tokens" in turns.columns else F.lit(None).cast("bigint")
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 40))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), counted.alias("counted"))
    rows = rows.select("conv_id", F.floor(F.col("turn") / block_turns).alias("block"), "turn", "role", "text", "counted", F.concat(escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    most = F.octet_length("head") + F.octet_length("body") + max(len(TURN), len(HISTORY)) + len(END)
    rows = rows.withColumn("tokens", F.coalesce("counted", most.cast("bigint"))).drop("counted")

    lead = rows.groupBy("conv_id").agg(F.min_by(F.struct("block", "role", "head", "body", "tokens"), F.struct("turn", "role", "text")).alias("s")).where("s.role = 'system'")
    lead = lead.select(F.col("conv_id").alias("_conv"), "s")
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body", "tokens"))).alias("p"))
    blocks = blocks.join(lead, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    blocks = blocks.withColumn("opens", F.coalesce(F.col("block") == F.col("s.block"), F.lit(False)))
    room = F.greatest(F.lit(1).cast("bigint"), F.lit(budget - history_budget) - F.coalesce("s.tokens", F.lit(0)))
    # The turns that the blocks before leave as history, one block or several short ones. Only those few pass the window.
    opening = F.when(F.col("opens"), F.lit(1)).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.lit(max_history), F.size("p") - opening))
    ends = blocks.select("conv_id", "block", F.slice("p", F.size("p") - last + 1, last).alias("tail"))
    ends = ends.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.flatten(F.collect_list("tail").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(-max_history - 1, -1))).alias("had"))
    ends = ends.withColumn("had", F.slice("had", F.greatest(F.lit(1), F.size("had") - max_history + 1), max(1, max_history)))
    blocks = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    blocks = blocks.withColumns({"had": F.coalesce("had", F.slice("p", 1, 0))}).withColumns({"n_had": F.size("had"), "p": F.concat("had", "p")})
    sums = F.aggregate("p", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["tokens"])))
    blocks = blocks.select("conv_id", "block", "s", "opens", "n_had", F.transform("p", lambda x: F.struct(x["role"].alias("role"), x["head"].alias("head"), x["body"].alias("body"), x["tokens"].alias("tokens"))).alias("p"), sums.alias("upto"), room.alias("room"))
    # ``starts``: indexes of the turns that open a span. A span goes on while the prefix sums say that the next turn fits.
    indexes = F.sequence(F.col("n_had"), F.size("p") - 1)
    fits = lambda a, i: F.get("upto", i + 1) - F.get("upto", F.element_at(a, -1)) <= F.col("room")
    starts = F.aggregate(indexes, F.array("n_had"), lambda a, i: F.when((i == F.col("n_had")) | fits(a, i), a).otherwise(F.concat(a, F.array(i))))
    # A window takes along only its own turns and those that may be its history, from ``low`` on.
    oldest = lambda a: F.greatest(a - max_history, F.when(F.col("opens"), F.lit(1)).otherwise(F.lit(0)))

    def window(a: Column, w: Column) -> Column:
        low, end = F.least(a, oldest(a)), F.coalesce(F.get("starts", w + 1), F.size("p"))
        return F.struct((a - low).alias("a"), F.slice("p", low + 1, end - low).alias("p"), F.slice("upto", low + 1, end - low + 1).alias("upto"), (F.col("s").isNotNull() & ~(F.col("opens") & (a == 0))).alias("leads"))

    spans = blocks.withColumn("starts", starts).select("conv_id", "block", "s", F.posexplode(F.transform("starts", window)).alias("window", "x")).select("conv_id", "block", "s", "window", "x.*")
    told = lambda mark, x: F.concat(F.lit(mark), x["head"], x["body"], F.lit(END))
    size = F.element_at("upto", -1) - F.get("upto", "a")
    lead = F.when(F.col("leads"), F.col("s.tokens")).otherwise(F.lit(0))
    # History gives way to a new turn that leaves it no room.
    spans = spans.withColumns({"size": size, "spare": F.least(F.lit(history_budget), F.lit(budget) - lead - size), "new": F.slice("p", F.col("a") + 1, F.size("p") - F.col("a"))})
    spans = spans.withColumn("past", F.filter(F.slice("p", 1, F.col("a")), lambda x, i: F.get("upto", "a") - F.get("upto", i) <= F.col("spare")))
    system = F.when(F.col("leads"), F.concat(F.lit(HISTORY), "s.head", "s.body", F.lit(END))).otherwise(F.lit(""))
    spans = spans.withColumns({"before": F.concat(system, F.array_join(F.transform("past", lambda x: told(HISTORY, x)), "")), "texts": F.transform("new", lambda x: told(TURN, x))})
    spans = spans.withColumn("at", F.aggregate("texts", F.array(F.length("before")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x)))))
    masks = F.transform("new", lambda x, i: F.when(x["role"] == "assistant", F.struct((F.get("at", i) + len(TURN) + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))
    n_tokens = lead + F.aggregate("past", F.lit(0).cast("bigint"), lambda t, x: t + x["tokens"]) + F.col("size")
    return spans.select("conv_id", "block", "window", F.concat("before", F.array_join("texts", "")).alias("formatted"), F.array_compact(masks).alias("loss"), n_tokens.alias("n_tokens"))


def read_turns(formatted: Column) -> Column:
    """The new turns of a window, read from its text: an array of ``(role, text)``."""
    parts = F.filter(F.split(formatted, r"<\|"), lambda x: x.startswith("turn|>"))
    bare = F.transform(parts, lambda x: F.substring(x, len("turn|>") + 1, 1 << 30))
    return F.transform(bare, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.regexp_replace(x, r"\A[^\n]*\n", "")).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers in a window, without the escapes."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"] + 1, x["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Windows -> one row per conversation, from the formatted text and its masks alone."""
    read = formatted.select("conv_id", "block", "window", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").alias("chars"))
    read = read.select("conv_id", F.struct("block", "window", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"), "loss").alias("w"), F.size("t").cast("bigint").alias("n"), "chars")
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"))
    loss = F.array_join("w.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
