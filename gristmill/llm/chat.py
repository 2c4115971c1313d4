"""Chat formatting with DataFrame expressions only.

A conversation's turns are collected as structs, sorted, and written in a template
of control strings; adjacent turns of one role share a block:

    <|im_start|>ROLE\\nTEXT<|im_next|>TEXT<|im_end|>\\n

Texts and roles are escaped reversibly: a backslash is put after the first ``<`` of
every ``<``, backslashes, ``|``; so ``<|`` never stands in an escaped text, and
taking one backslash away restores it.  In roles, backslashes and line feeds are
escaped too, so that the first line feed ends the role.

``loss_spans`` marks the assistant's texts: half-open code point ranges of the
formatted text, one for each assistant turn.

Long conversations: nothing is appended turn by turn to a growing value.  Offsets are
summed in chunks of about the square root of the turns, and texts under the mask are cut
from pages of the formatted text, so work grows as n to the power 1.5 in turns at most.

Defined cases: null text is empty; null role is empty; each row without a conversation
id is a conversation of its own (so they are no hot group); equal turn numbers (null first) order by role, then text;
repeated rows are turns of their own.  Empty table: no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(unescape_text(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once: what stands in a lambda's body is computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running_sums(values: Column) -> Column:
    """array<long>: the sum of what stands before each value of an array<long>."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    append = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    cut = lambda v, size: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda c: F.slice(v, c * size + 1, size))
    totals = lambda parts: F.aggregate(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), F.array(zero), append)
    within = lambda parts, before: F.flatten(F.transform(parts, lambda p, c: F.slice(F.aggregate(p, F.array(F.get(before, c)), append), 1, F.size(p))))
    summed = lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: let(cut(v, size), lambda parts: let(totals(parts), lambda before: within(parts, before))))
    return let(values, lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(none))


def format_chats(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start:long,end:long>>."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("__alone")
    chats = conversations.select("conv_id", alone, turn.alias("__turn")).groupBy("conv_id", "__alone").agg(F.array_sort(F.collect_list("__turn")).alias("turns"))
    last = F.size("turns") - 1
    at = lambda i: F.get("turns", i)
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    # Blocks: a role and its run of texts.
    block = lambda s, end: F.struct(at(s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, end - s), lambda t: escape_text(t["text"])).alias("texts"))
    blocks = let(starts, lambda held: F.transform(held, lambda s, k: block(s, F.coalesce(F.get(held, k + 1), F.size("turns")))))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
    chats = chats.select("conv_id", F.transform("blocks", lambda b: F.struct(head(b).alias("head"), b["texts"].alias("texts"), (b["role"] == learn).alias("learn"))).alias("blocks"))
    # Pieces in order: (length before the text, length of the text, length after it, learn).
    piece = lambda b: F.transform(b["texts"], lambda x, j: F.struct(F.when(j == 0, F.length(b["head"])).otherwise(len(NEXT)).cast("long").alias("lead"), F.length(x).cast("long").alias("body"), F.when(j == F.size(b["texts"]) - 1, len(END)).otherwise(0).cast("long").alias("tail"), b["learn"].alias("learn")))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END))), "")
    done = chats.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("blocks", piece)).alias("pieces"))
    done = done.withColumn("sums", running_sums(F.transform("pieces", lambda p: p["lead"] + p["body"] + p["tail"])))
    span = lambda p, at: F.struct((at + p["lead"]).alias("start"), (at + p["lead"] + p["body"]).alias("end"))
    spans = F.zip_with("pieces", "sums", lambda p, at: F.when(p["learn"], span(p, at)))
    return done.select("conv_id", "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def parse_chats(formatted: Column) -> Column:
    """The turns read back from a formatted text: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    body = lambda b: F.substr(b, F.lit(1), F.length(b) - len(END))
    role = lambda b: unescape_role(F.substring_index(b, "\n", 1))
    texts = lambda b: F.split(F.substr(body(b), F.instr(b, "\n") + 1), r"<\|im_next\|>")
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda x: F.struct(role(b).alias("role"), unescape_text(x).alias("text")))))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, each cut from the pages of the text that it lies in."""

    def text(pages: Column, size: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / size).cast("int"), F.floor(s["end"] / size).cast("int")
        part = F.array_join(F.slice(pages, first + 1, last - first + 1), "")
        return unescape_text(F.substr(part, (s["start"] - first * size + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    pages = lambda size, chars: F.transform(F.sequence(F.lit(0), F.floor(chars / size).cast("int")), lambda k: F.substr(formatted, k * size + 1, size))
    cut = lambda size, chars: let(pages(size, chars), lambda held: F.transform(spans, lambda s: text(held, size, s)))
    return let(F.length(formatted), lambda chars: let(F.greatest(F.lit(1024), F.ceil(chars / F.sqrt(F.size(spans) + 1)).cast("int")), lambda size: cut(size, chars)))
