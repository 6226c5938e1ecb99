"""Chat formatting with typed content parts.

A conversation's turns become one text: each turn is marked, its parts are flattened in
order, and control strings that occur inside a text are escaped reversibly.  Text parts keep
their text; image, audio and document parts become placeholders, with an attachment record
each and the number of tokens it expands to.  Spans of the loss mask cover the contents of the
trained roles.

Escaping puts one backslash behind the first character of a control string; if there are
backslashes already, one more.  Taking one away restores the text, so every text survives.

Everything is DataFrame functions.  A conversation is one row of the result, so its turns
meet in one task; rows of different conversations never do.

Defined cases: null texts, roles and part lists are empty; turns order by ``turn`` (null first),
equal turns by role and content, and repeated rows are kept as turns; rows with a null
``conv_id`` are one conversation; unknown part kinds become attachments of no tokens; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The template's own marks, and what common chat templates use.
OPEN, CLOSE = "<|turn|>", "<|end|>"
START, STOP = "<s>", "</s>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = ("assistant",)

# Tokens that attachments expand to.
IMAGE_PATCH = 28
AUDIO_TOKENS_PER_SECOND = 12.5
DOCUMENT_TOKENS_PER_PAGE = 512
PART = (
    "struct<kind: string, text: string, uri: string, width: int, height: int, "
    "seconds: double, pages: int>"
)


def _place_pattern(more: str) -> str:
    """Backslashes between the first character of a control string and its rest."""
    firsts = "".join(re.escape(c) for c in sorted({c[0] for c in CONTROLS}))
    rests = "|".join(re.escape(c[1:]) for c in CONTROLS)
    return rf"(?<=[{firsts}]){more}(\\*)(?={rests})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_place_pattern("")), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_place_pattern(r"\\")), F.lit("$1"))


def _escape_role(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
    return escape(one_line)


def _unescape_role(role: Column) -> Column:
    plain = unescape(role)
    # "\b" stands for a backslash, so no other backslash can precede the "n" of a line feed.
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to."""
    patches = lambda side: F.ceil(F.coalesce(part[side], F.lit(0)) / IMAGE_PATCH)
    seconds = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND)
    pages = F.coalesce(part["pages"], F.lit(0)) * DOCUMENT_TOKENS_PER_PAGE
    return (
        F.when(part["kind"] == "image", patches("width") * patches("height"))
        .when(part["kind"] == "audio", seconds)
        .when(part["kind"] == "document", pages)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column) -> Column:
    """What a part contributes to the text of its turn."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    name = F.regexp_replace(kind, F.lit("[^a-z]"), F.lit(""))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), name, F.lit("|>"))
    )


def content_of(parts: Column) -> Column:
    """The text of a turn; neighbouring text parts are joined before they are escaped."""
    one = F.struct(F.lit("").alias("text"), F.lit("").alias("done"))

    def add(state: Column, part: Column) -> Column:
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        more = F.concat(state["text"], F.coalesce(part["text"], F.lit("")))
        closed = F.concat(state["done"], escape(state["text"]), visit(part))
        return F.struct(
            F.when(is_text, more).otherwise(F.lit("")).alias("text"),
            F.when(is_text, state["done"]).otherwise(closed).alias("done"),
        )

    return F.aggregate(parts, one, add, lambda s: F.concat(s["done"], escape(s["text"])))


def text_parts(text: Column) -> Column:
    """One text part, for tables that hold plain texts."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    ).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts).

    ``formatted`` text, ``loss_spans`` (start, length: code points from 0), ``attachments``
    (turn, part, kind, uri, tokens: in the order of the placeholders) and
    ``attachment_tokens``.
    """
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    each = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            content_of(parts).alias("content"),
            F.transform(
                F.filter(
                    F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                    lambda x: F.coalesce(x["p"]["kind"], F.lit("text")) != "text",
                ),
                lambda x: F.struct(
                    x["i"].alias("part"), x["p"]["kind"].alias("kind"), x["p"]["uri"].alias("uri"),
                    part_tokens(x["p"]).alias("tokens"),
                ),
            ).alias("attachments"),
        ).alias("row"),
    )
    grouped = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    headed = grouped.withColumn(
        "rows",
        F.transform(
            "rows",
            lambda r: F.struct(
                F.concat(F.lit(OPEN), _escape_role(r["role"]), F.lit("\n")).alias("head"),
                r["content"].alias("content"),
                r["role"].isin(*trained).alias("trained"),
                r["attachments"].alias("attachments"),
            ),
        ),
    )
    tail = CLOSE + "\n"
    body = F.array_join(
        F.transform("rows", lambda r: F.concat(r["head"], r["content"], F.lit(tail))), ""
    )

    def add_span(state: Column, r: Column) -> Column:
        start = state["at"] + F.length(r["head"])
        length = F.length(r["content"])
        span = F.array(F.struct(start.alias("start"), length.cast("long").alias("length")))
        return F.struct(
            (start + length + len(tail)).cast("long").alias("at"),
            F.when(r["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(
        F.lit(len(START)).cast("long").alias("at"),
        F.array().cast("array<struct<start: long, length: long>>").alias("spans"),
    )
    attachments = F.flatten(
        F.transform(
            "rows",
            lambda r, t: F.transform(
                r["attachments"],
                lambda a: F.struct(
                    t.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"),
                    a["uri"].alias("uri"), a["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return headed.select(
        "conv_id",
        F.concat(F.lit(START), body, F.lit(STOP)).alias("formatted"),
        F.aggregate("rows", empty, add_span)["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn(
        "attachment_tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay."""
    inner = F.substring(formatted, len(START) + 1, F.length(formatted) - len(START) - len(STOP))
    pieces = F.filter(
        F.split(inner, re.escape(OPEN)), lambda piece, i: i > 0
    )

    def parse(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        text = F.substring(piece, cut + 1, F.length(piece) - cut - len(CLOSE) - 1)
        return F.struct(
            _unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text")
        )

    return F.transform(pieces, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(
        spans,
        lambda s: unescape(
            F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
    return F.array_join(cut, "")


def joined(turns: Column) -> Column:
    """role, line feed, text, line feed of every turn."""
    return F.array_join(
        F.transform(
            turns, lambda t: reduce(F.concat, [t["role"], F.lit("\n"), t["text"], F.lit("\n")])
        ),
        "",
    )
