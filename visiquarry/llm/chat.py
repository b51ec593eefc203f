"""Chat formatting with typed content parts, in DataFrame functions alone.

A message's content is an array of parts (type, text, uri, tokens). A visitor writes each part in order: text as it is, with
control strings escaped; an image, audio or document part as a placeholder, noted with its reference, where it stands, and the
tokens that it expands to. Turns are written as <|im_start|>role, newline, content, <|im_end|>, newline.

Escaping is reversible: '%' becomes '%25', then '<|', which begins every control string, becomes '%3C|'; a newline in a role
becomes '%0A'. The loss mask has the places of assistant contents in the formatted text.

Defined results: null texts and roles count as empty, a null part or a part of unknown type writes nothing; turns of a
conversation come by turn, nulls first, equal turns by role and content; rows of a null conv_id are one conversation; repeated
rows are repeated turns; an empty table gives the added conversations alone, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, FINISH = "<|im_start|>", "<|im_end|>"
#: Tokens that a part without a count of its own expands to.
TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "array<struct<type:string,text:string,uri:string,tokens:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("tokens")))


def _attached(part: Column) -> Column:
    return part["type"].isin(*TOKENS)


def write_part(part: Column) -> Column:
    """What the visitor writes for a part."""
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).when(_attached(part), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise("")


def _expanded(part: Column) -> Column:
    count = F.lit(0)
    for kind, n in TOKENS.items():
        count = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(n))).otherwise(count)
    return count


def format_chat(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts): formatted text, loss mask, attachments, expanded tokens.

    ``loss_mask`` has (start, length) in code points; ``attachments`` has (turn, part, type, uri, tokens) in order.
    """
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(PART), F.array().cast(PART)).alias("parts"))
    rows = rows.withColumn("content", F.array_join(F.transform("parts", lambda p: F.coalesce(write_part(p), F.lit(""))), ""))
    rows = rows.withColumn("head", F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("written", F.concat("head", "content", F.lit(FINISH + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "start": F.sum(F.length("written")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("written") + F.length("head"),
    })
    kept = F.transform("parts", lambda p, i: F.struct(F.col("turn"), i.alias("part"), p["type"].alias("type"), p["uri"].alias("uri"), _expanded(p).alias("tokens")))
    rows = rows.withColumn("attached", F.filter(kept, lambda p: p["type"].isin(*TOKENS)))
    every = F.sort_array(F.collect_list(F.struct("place", "written", "role", "start", F.length("content").alias("length"), "attached")))
    out = rows.groupBy("conv_id").agg(every.alias("every"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("every", lambda m: m["written"]), "").alias("formatted"),
        F.transform(F.filter("every", lambda m: m["role"] == loss_role), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))).alias("loss_mask"),
        F.flatten(F.transform("every", lambda m: m["attached"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay as they are written."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")
    body = lambda t: F.substring_index(t, FINISH, 1)
    role = lambda t: F.substring_index(body(t), "\n", 1)
    return F.transform(turns, lambda t: F.struct(unescape_role(role(t)).alias("role"), unescape(F.substr(body(t), F.length(role(t)) + 2)).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
