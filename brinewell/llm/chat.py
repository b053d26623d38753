"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events (a message opened, text streamed as deltas, edited or
regenerated) is partitioned by conversation, sorted by the conversation's
sequence and folded into final messages, which are then rendered. An event
changes one message, so a conversation is dealt out by its messages and folded
by many tasks; messages meet first in chunks of CHUNK turns and only the chunks
meet as a whole. The loss mask is a list of spans of the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.arrays import let, pieces, sums

#: Fixed values of the template.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
#: Control strings of this and of other common templates, and what stands for them inside texts.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("|>", "|&gt;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lsqb;INST]"), ("[/INST]", "&lsqb;/INST]"))
UNESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&lsqb;", "["), ("&amp;", "&"))
CHUNK = 64
TRAINED_ROLE = "assistant"


def _replace(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    """No control string is left in the result, and ``unescape`` gives the text back."""
    return _replace(c, ESCAPES)


def unescape(c: Column) -> Column:
    return _replace(c, UNESCAPES)


def events_from_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log ``(conv_id, turn, message, seq, kind, role, text)`` that ends in the given rows.

    The rows are what is left of chats, so the events before are made up by a
    fixed rule: the model's replies are streamed, broken off, regenerated and
    streamed again in three deltas; other messages are sent with the first half
    of their text and edited once the next turn has begun. ``seq`` runs through
    the conversation, eight numbers a turn.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.monotonically_increasing_id().alias("message"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    third = F.ceil(F.length("body") / 3).cast("int")

    def event(at: int, kind: str, text: Column) -> Column:
        seq = F.coalesce(F.try_add(F.try_multiply("turn", F.lit(8)), F.lit(at)), F.lit(at)).cast("long")
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(at == 0), F.col("role")).alias("role"), text.alias("text"))

    none = F.lit("")
    parts = [event(4 + k, "delta", F.substring("body", third * k + 1, third)) for k in range(3)]
    streamed = F.array(event(0, "message", none), event(1, "delta", F.substring("body", 1, 8)), event(2, "delta", F.lit("...")), event(3, "regenerate", none), *parts)
    sent = F.array(event(0, "message", F.substring(F.col("body"), F.lit(1), F.floor(F.length("body") / 2).cast("int"))), event(9, "edit", F.col("body")))
    return rows.select("conv_id", "turn", "message", F.inline(F.when(F.col("role") == TRAINED_ROLE, streamed).otherwise(sent)))


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: each message's final state.

    Events are applied by ``seq`` (ties: by kind, then text). ``message`` and
    ``edit`` set the text, ``delta`` appends, ``regenerate`` starts anew with
    its own text. Null texts count as empty; the role is that of the last event
    that has one. What comes before the last event that sets the text has no
    part in it, so the fold joins that event's text and the deltas after it.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")))
    grouped = events.groupBy("conv_id", "turn", "message").agg(steps.alias("steps"))
    from_ = F.coalesce(F.array_max(F.transform("steps", lambda e, i: F.when(e["kind"] != "delta", i + 1))), F.lit(1))
    live = F.slice("steps", from_, F.size("steps"))
    role = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.array_compact(F.transform("steps", lambda e: e["role"]))), -1), F.lit(""))
    return grouped.select("conv_id", "turn", role.alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``, one row per conversation.

    ``loss`` is the mask: spans ``(start, end)`` of ``formatted`` in code
    points, one for each assistant message, in order; the model learns from
    these alone. Messages are in order of turn (null turns last), then role and
    text, so ties and repeated rows have a defined order and all stay. Rows
    without a conversation id form a conversation of their own. An empty log
    gives no rows; columns that are not named here are not read.
    """
    final = fold_events(events)
    message = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    chunks = final.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(message)).alias("part"))
    place = F.struct(F.col("chunk").isNull().alias("last"), "chunk", "part")
    chats = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("parts"))

    def render(m: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(m["role"]), F.lit(SHUT))
        return F.struct(F.concat(head, escape(m["text"]), F.lit(END)).alias("text"), F.length(head).alias("head"), (m["role"] == TRAINED_ROLE).alias("trained"))

    rendered = F.transform(F.flatten(F.transform("parts", lambda p: p["part"])), render)
    chats = chats.select("conv_id", rendered.alias("m"))

    def spans(ends: Column) -> Column:
        every = F.transform("m", lambda m, i: F.when(m["trained"], F.struct((ends[i] - F.length(m["text"]) + m["head"]).alias("start"), (ends[i] - len(END)).alias("end"))))
        return F.array_compact(every)

    loss = let(sums(F.transform("m", lambda m: F.length(m["text"]))), spans)
    return chats.select("conv_id", F.array_join(F.col("m.text"), "").alias("formatted"), loss.alias("loss"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(pieces(formatted, loss, lambda span, gap, own: unescape(own)), "")


def parse_chat(formatted: Column) -> Column:
    """The messages ``array<struct<role, text>>`` of a rendered conversation."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def back(p: Column) -> Column:
        head = F.substring_index(p, SHUT, 1)
        body = F.substring(p, F.length(head) + len(SHUT) + 1, F.length(p))
        return F.struct(unescape(F.substring(head, len(OPEN) + 1, F.length(head))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, back)
