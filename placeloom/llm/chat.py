"""Chat formatting in budgeted windows, DataFrame functions only.

Template of one turn: ``<|turn|>role\\ntext<|end|>`` for a turn shown for the first time and
``<|past|>role\\ntext<|end|>`` for a repeated one (the retained system turn and the limited history of later
windows). Inside roles and texts ``&`` becomes ``&amp;`` and the first character of every control string of
this and of common templates becomes an entity, so no control string survives in a text and unescaping is exact.
Prefix sums of turn tokens choose turn-aligned spans: a span grows until the next turn would exceed what the
budget leaves beside the system turn and the history allowance. Only texts of assistant turns shown for the
first time lie under the loss mask.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.arrays import running_sums
from placeloom.functions.extract import bound
from pyspark.sql import Window as W

# fixed values: control strings whose first character is escaped
ANGLE = r"<(?=\||/?s>|</?SYS>>)"
SQUARE = r"\[(?=/?INST\])"
OVERHEAD = 4


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(F.regexp_replace(out, ANGLE, "&lt;"), SQUARE, "&#91;")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(F.replace(out, F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def turn_tokens(text: Column) -> Column:
    """Token estimate of a turn: word runs and single symbols, plus the markers."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + OVERHEAD


def conversation_windows(turns: DataFrame, budget: int = 512, history: int = 128, tokens: Callable[[Column], Column] = turn_tokens) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` -> ``(conv_id, windows)``, windows an array of
    ``(window, formatted, loss, tokens, over_budget)``; loss holds ``(start, length)`` code-point spans, 0-based.

    Turns are ordered by turn, role, text (nulls first), so ties have one order and repeated rows stay. Null
    roles and texts are empty. A turn that alone exceeds the budget makes a window of its own with
    ``over_budget``; nothing is cut. A null conv_id is one conversation. Other columns are ignored. A
    conversation is one row of the result and so must fit Spark's row limit; only its turns meet in a task. An empty table
    gives no rows. ``tokens`` counts a turn's tokens from its text; the default is an estimate.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tok", tokens(F.col("text")))
    # prefix sums of turn tokens; the groups below have the same partitioning
    so_far = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("tok").over(so_far))
    one = F.struct("turn", "role", "text", "tok", "upto")
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    has_system = F.col("t")[0]["role"] == "system"
    conv = conv.withColumn("skip", F.when(has_system, 1).otherwise(0)).withColumn(
        "sys_tok", F.when(has_system, F.col("t")[0]["tok"]).otherwise(F.lit(0).cast("long"))
    )
    # over the turns after the system turn: p[i] = tokens before turn skip + i
    rest = F.slice("t", F.col("skip") + 1, F.greatest(F.size("t") - F.col("skip"), F.lit(0)))
    conv = conv.withColumn("p", F.concat(F.array(F.lit(0).cast("long")), F.transform(rest, lambda x: x["upto"] - F.col("sys_tok"))))
    n = F.size("p") - 1
    room = F.lit(budget) - F.col("sys_tok")
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("base"), room.cast("long").alias("room"))

    def grow(acc: Column, i: Column) -> Column:
        full = (i > F.element_at(acc["starts"], -1)) & (F.get("p", i + 1) - acc["base"] > acc["room"])
        return F.struct(
            F.when(full, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
            F.when(full, F.get("p", i)).otherwise(acc["base"]).cast("long").alias("base"),
            F.when(full, room - history).otherwise(acc["room"]).cast("long").alias("room"),
        )

    conv = conv.withColumn(
        "starts", F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, grow, lambda a: a["starts"])).otherwise(F.array(F.lit(0)))
    )

    def window(first: Column, k: Column) -> Column:
        last = F.coalesce(F.get("starts", k + 1), n)
        here = F.get("p", first)
        # longest run of turns right before the window within the history allowance
        back = F.size(F.filter(F.slice("p", 1, first), lambda before: here - before <= history))
        back = F.when(k > 0, back).otherwise(0)
        turn = lambda past: lambda x: F.struct(F.lit(past).alias("past"), x["role"].alias("role"), x["text"].alias("text"), x["tok"].alias("tok"))
        head = F.transform(F.slice("t", 1, F.col("skip")), lambda x: F.struct((k > 0).alias("past"), x["role"].alias("role"), x["text"].alias("text"), x["tok"].alias("tok")))
        repeated = F.transform(F.slice("t", F.col("skip") + first - back + 1, back), turn(True))
        shown = F.transform(F.slice("t", F.col("skip") + first + 1, F.greatest(last - first, F.lit(0))), turn(False))
        return F.struct(k.alias("window"), F.concat(head, repeated, shown).alias("turns"))

    conv = conv.select("conv_id", F.transform("starts", window).alias("w"))

    def render(w: Column) -> Column:
        parts = F.transform(
            w["turns"],
            lambda x: F.struct(
                F.concat(F.when(x["past"], "<|past|>").otherwise("<|turn|>"), escape_role(x["role"]), F.lit("\n")).alias("head"),
                escape(x["text"]).alias("body"),
                (~x["past"] & (x["role"] == "assistant")).alias("loss"),
            ),
        )
        spans = "array<struct<start:bigint,length:bigint>>"
        size = lambda x: (F.length(x["head"]) + F.length(x["body"]) + len("<|end|>")).cast("long")

        def masked(parts: Column) -> Column:
            placed = F.zip_with(parts, running_sums(F.transform(parts, size)), lambda x, before: F.struct((before + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"), x["loss"].alias("loss")))
            return F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).cast(spans)

        total = F.aggregate(w["turns"], F.lit(0).cast("long"), lambda a, x: a + x["tok"])
        return F.struct(
            w["window"].alias("window"),
            F.array_join(F.transform(parts, lambda x: F.concat(x["head"], x["body"], F.lit("<|end|>"))), "").alias("formatted"),
            bound(parts, masked).alias("loss"),
            total.alias("tokens"),
            (total > budget).alias("over_budget"),
        )

    return conv.select("conv_id", F.transform("w", render).alias("windows"))


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """One row per training window: ``(conv_id, window, formatted, loss, tokens, over_budget)``."""
    return conversation_windows(turns, budget, history).select("conv_id", F.inline("windows"))


def chat_digest(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Per conversation, read back from the formatted windows: turn count, digests and sizes."""
    w = conversation_windows(turns, budget, history)
    mark = len("<|turn|>")
    pieces = F.flatten(F.transform("windows", lambda x: F.filter(F.split(x["formatted"], r"<\|end\|>", -1), lambda y: y.startswith("<|turn|>"))))
    # a piece after its marker is role, newline, text; unescaping as a whole is exact since escaped roles hold no newline
    said = F.transform(pieces, lambda x: F.concat(unescape(F.substr(x, F.lit(mark + 1))), F.lit("\n")))
    masked = F.flatten(
        F.transform(
            "windows",
            lambda x: F.transform(x["loss"], lambda s: unescape(F.substr(x["formatted"], (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        )
    )
    out = w.select(
        "conv_id",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.array_join(masked, "").alias("loss_text"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, x: a + F.length(x["formatted"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"),
    )
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_windows"
    )
