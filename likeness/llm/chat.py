"""Chat formatting with typed content parts, with DataFrame functions alone.

A turn's content is a list of parts. Each kind of part has its own way to become text:
text parts are escaped, image, audio and document parts become a placeholder for each
token they expand to, numbered in order, and leave an attachment reference. A turn is

    <|turn|>role<|text|>content<|end|>

Inside roles and contents ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and
``&#91;``, so no control string of this template or of another (``</s>``, ``[INST]``) can
come from a text, and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import key

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Fixed spellings, in the order in which they are written; read back in reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
PART = (
    "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
)
# Tokens an attachment expands to: image patches of this many pixels a side, audio tokens
# a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 256
KINDS = ("text", "image", "audio", "document")
# Placeholders of one part at most; more is an error, as the text would hold them all.
MOST_TOKENS = 100_000
NONE = "CAST(array() AS array<struct<kind:string,uri:string,tokens:int>>)"


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """Content of one text part; a null text is an empty one."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("uri"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def part_tokens(part: Column) -> Column:
    """Placeholders of one part: 0 for text, else at least 1. A part without a type is text; an
    unknown type and more than MOST_TOKENS placeholders are errors that say so."""
    across = F.ceil(F.coalesce(part["width"], F.lit(1)) / F.lit(PATCH))
    down = F.ceil(F.coalesce(part["height"], F.lit(1)) / F.lit(PATCH))
    heard = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(AUDIO_RATE))
    read = F.coalesce(part["pages"], F.lit(1)) * F.lit(PAGE_TOKENS)
    kinds = F.when(part["type"] == "image", across * down)
    kinds = kinds.when(part["type"] == "audio", heard).when(part["type"] == "document", read)
    strange = F.raise_error(F.concat(F.lit("unknown type of a part: "), part["type"])).cast("int")
    large = F.raise_error(F.concat(F.lit("too large a part: "), kinds.cast("string"))).cast("int")
    return (
        F.when(~F.coalesce(part["type"], F.lit("text")).isin(*KINDS), strange)
        .when(kinds.isNull(), 0)
        .when(kinds > MOST_TOKENS, large)
        .otherwise(F.greatest(kinds.cast("int"), F.lit(1)))
    )


def flattened(parts: Column, first: Column) -> Column:
    """Struct (text, attachments) of a content; attachments count on from ``first``."""
    zero = F.struct(F.lit("").alias("text"), F.expr(NONE).alias("attachments"))

    def step(state, part):
        tokens = part_tokens(part)
        number = first + F.size(state["attachments"])
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), number, F.lit("|>"))
        shown = F.when(tokens > 0, F.repeat(mark, tokens)).otherwise(
            escaped(F.coalesce(part["text"], F.lit("")))
        )
        kept = F.struct(part["type"].alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens"))
        more = F.when(tokens > 0, F.array(kept)).otherwise(F.expr(NONE))
        return F.struct(
            F.concat(state["text"], shown).alias("text"),
            F.concat(state["attachments"], more).alias("attachments"),
        )

    return F.aggregate(parts, zero, step)


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    learn: str = "assistant",
) -> DataFrame:
    """One row a conversation: the id, ``formatted``, ``attachments`` in order (kind, uri,
    tokens), ``n_tokens_expanded``, and ``loss``, the spans (start, end) in code points of
    ``formatted`` that hold contents of the role ``learn``.

    ``content`` is an array of ``PART`` structs. Turns are ordered by turn, then role, then
    the text of the content; a null turn comes first, a null role is an empty one, a null
    content has no parts. Rows without a conversation id make up one conversation. Repeated
    rows are turns of their own. Other columns are left out. A conversation is one value,
    so its turns meet in one row; conversations are dealt out by id.
    """
    parts = F.coalesce(F.col(key(content)), F.expr(f"CAST(array() AS array<{PART}>)"))
    one = F.struct(
        F.col(key(turn)).alias("turn"),
        F.coalesce(F.col(key(role)), F.lit("")).alias("role"),
        parts.alias("parts"),
    )
    grouped = turns.groupBy(F.col(key(conv)).alias(conv)).agg(
        F.sort_array(F.collect_list(one)).alias("turns")
    )
    zero = F.struct(
        F.lit("").alias("text"),
        F.lit(0).alias("length"),
        F.expr(NONE).alias("attachments"),
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("loss"),
    )

    def step(state, one):
        flat = flattened(one["parts"], F.size(state["attachments"]))
        head = F.concat(F.lit(TURN), escaped(one["role"]), F.lit(TEXT))
        start = state["length"] + F.length(head)
        end = start + F.length(flat["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            F.concat(state["text"], head, flat["text"], F.lit(END)).alias("text"),
            (end + F.lit(len(END))).alias("length"),
            F.concat(state["attachments"], flat["attachments"]).alias("attachments"),
            F.when(one["role"] == learn, F.concat(state["loss"], span))
            .otherwise(state["loss"])
            .alias("loss"),
        )

    done = grouped.withColumn("whole", F.aggregate("turns", zero, step))
    return done.select(
        F.col(key(conv)),
        F.col("whole.text").alias("formatted"),
        F.col("whole.attachments").alias("attachments"),
        F.aggregate("whole.attachments", F.lit(0), lambda n, a: n + a["tokens"]).alias(
            "n_tokens_expanded"
        ),
        F.col("whole.loss").alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs (role, text), unescaped."""
    each = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s: s != "")
    return F.transform(
        each,
        lambda s: F.struct(
            unescaped(F.substring_index(s, TEXT, 1)).alias("role"),
            unescaped(
                F.substring_index(F.substring_index(s, TEXT, -1), END, 1)
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, one piece after the other."""
    pieces = F.transform(
        loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    )
    return F.array_join(pieces, "")
