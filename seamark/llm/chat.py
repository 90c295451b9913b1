"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order; a part that isn't text
becomes a placeholder, with a reference to its attachment and the number of tokens it expands to. Turns go into a template
whose control strings are escaped inside texts, so that the formatted string reads back exactly.

A message's text is that of its text parts, joined; also a control string that only arises in the joint is escaped. Texts may
be of any length; columns but conv_id, turn, role and parts are left away.

Turns are ordered by turn, nulls first, then role, then text; repeated rows are repeated turns. A null role is "", a null
text or null list of parts is empty, a null conv_id is a conversation of its own. Empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import whole

#: The template: OPEN role MID text CLOSE for each turn.
OPEN, MID, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings that no text may bring in (fixed values): the template's own, and those of common chat formats.
CONTROL = (OPEN, MID, CLOSE, "<|image|>", "<|audio|>", "<|document|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A backslash, or the first character of a control string.
_FIRST = "|".join([r"\\", *(f"\\{c}(?={'|'.join(re.escape(x[1:]) for x in CONTROL if x[0] == c)})" for c in "<[")])
#: Tokens of a part that isn't text (parameters): pixels along a patch, seconds of a frame, tokens of a page.
PATCH, FRAMES_A_SECOND, PAGE_TOKENS = 14, 25, 512
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    r"""A backslash after the first character of each control string, and each backslash doubled."""
    return F.regexp_replace(text, _FIRST, r"$0\\")


def unescape(text: Column) -> Column:
    """Reads back: drops the second backslash of two, and one that follows the first character of a control string."""
    return F.regexp_replace(text, r"(\\|<|\[)\\", "$1")


def text_part(text: Column) -> Column:
    """A message of a single text part."""
    null = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("uri"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    return F.array(part)


def part_tokens(part: Column) -> Column:
    """Tokens that the placeholder expands to; 0 for text, 1 at least for the others."""
    n = lambda c: F.coalesce(c, F.lit(0))
    image = F.ceil(n(part["width"]) / PATCH) * F.ceil(n(part["height"]) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_A_SECOND)
    size = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", n(part["pages"]) * PAGE_TOKENS)
    return F.when(part["type"] == "text", F.lit(0)).otherwise(F.greatest(F.coalesce(size, F.lit(0)), F.lit(1))).cast("long")


#: Marks of the parts while a message's texts are escaped as one string; no control string has such a character.
_MARKS = {"image": "\x00i", "audio": "\x00a", "document": "\x00d"}


def visit(parts: Column) -> dict[str, Column]:
    """What the visitor makes of a message: its escaped content, attachments in order, and their tokens.

    Texts are escaped after all parts are joined, so that no control string arises where two of them meet. An unknown type is
    treated like a document without pages. A null part is skipped.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    mark = lambda p: F.when(p["type"] == "image", _MARKS["image"]).when(p["type"] == "audio", _MARKS["audio"]).otherwise(_MARKS["document"])
    own = lambda t: F.replace(whole(t), F.lit("\x00"), F.lit("\x00t"))
    content = escape(F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", own(p["text"])).otherwise(mark(p))), ""))
    for kind, m in _MARKS.items():
        content = F.replace(content, F.lit(m), F.lit(f"<|{kind}|>"))
    content = F.replace(content, F.lit("\x00t"), F.lit("\x00"))
    others = F.filter(parts, lambda p: ~p["type"].eqNullSafe(F.lit("text")))
    refs = F.transform(others, lambda p, i: F.struct(i.alias("no"), p["type"].alias("type"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")))
    return {"content": content, "attachments": refs, "part_tokens": F.aggregate(refs, F.lit(0).cast("long"), lambda a, r: a + r["tokens"])}


def chat(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> one row per conversation: conv_id, n_turns, formatted, mask, attachments, part_tokens.

    mask is array<struct<start, end>>: code point offsets into formatted of the assistant's contents, end exclusive.
    Offsets are running sums over the turns in order, taken before the turns are gathered.
    """
    n = F.char_length
    seen = visit(F.col("parts"))
    rows = messages.select("conv_id", "turn", whole("role").alias("role"), *(c.alias(k) for k, c in seen.items()))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(n("head") + n("content") + len(CLOSE)).over(order).cast("int") - len(CLOSE)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - n("content"))
    # Every turn takes up characters, so `end` orders them.
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("end", "start", "role", "head", "content", "attachments", "part_tokens"))).alias("m"))
    return df.select(
        "conv_id",
        F.size("m").cast("long").alias("n_turns"),
        F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["content"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("m", lambda m: m["role"] == "assistant"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("mask"),
        F.flatten(F.transform("m", lambda m, t: F.transform(m["attachments"], lambda a: F.struct(t.alias("turn_no"), a.alias("ref"))))).alias("attachments"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, m: a + m["part_tokens"]).alias("part_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns (array<struct<role, text>>, parsed from formatted) and loss_texts (formatted under the mask, unescaped)."""
    pieces = F.slice(F.split("formatted", re.escape(OPEN), -1), 2, F.greatest(F.col("n_turns").cast("int"), F.lit(0)))
    turn = lambda p: F.split(F.substring(p, F.lit(1), F.char_length(p) - len(CLOSE)), re.escape(MID), 2)
    df = chats.withColumn("turns", F.transform(F.transform(pieces, turn), lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text"))))
    return df.withColumn("loss_texts", F.transform("mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))))


def report(messages: DataFrame) -> DataFrame:
    """Digests of what read_back() finds, per conversation."""
    df = read_back(chat(messages))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
