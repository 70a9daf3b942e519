"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them, in order,
into template text: text parts are escaped, image, audio and document parts
become one placeholder each, and their reference and the number of model tokens
they expand to are recorded beside the text. The template marks turns with
control strings; control strings inside texts are escaped and can be restored
exactly. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"

# A control string is an opener, then one of the tails. Escaping puts one more
# backslash between the two, reading takes one away; openers occur in no tail,
# so the two are exact inverses. The template's own and the common foreign
# control strings are covered.
_OPENER, _TAIL = r"(<|\[)", r"(\||/?s>|/?INST\])"
ESCAPE = (_OPENER + r"(\\*)" + _TAIL, r"$1\\$2$3")
RESTORE = (_OPENER + r"\\(\\*)" + _TAIL, r"$1$2$3")

PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def restore(text: Column) -> Column:
    return F.regexp_replace(text, *RESTORE)


def text_part(text: Column) -> Column:
    """A single text part; null reads as empty."""
    return F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))


def expanded_tokens(part: Column, patch: int = PATCH, audio_rate: float = AUDIO_RATE, page_tokens: int = PAGE_TOKENS) -> Column:
    """Model tokens a part's placeholder stands for: one per image patch, per slice of audio, per share of a page."""
    side = lambda name: F.greatest(F.ceil(F.coalesce(part[name], F.lit(0)) / patch), F.lit(1))
    return (F.when(part["kind"] == "image", side("width") * side("height"))
            .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate), F.lit(1)))
            .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens)
            .otherwise(0).cast("bigint"))


def visit(part: Column) -> Column:
    """Template text of one part. A part of unknown kind is read as text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation.

    ``formatted``: the template text. ``segments``: its pieces in order, as
    (text, loss); joined they are ``formatted``, and the loss mask is on for the
    text parts of the trained role. ``attachments``: (position, kind, ref,
    tokens) in order of the placeholders. ``n_turns``, ``expanded_tokens``.

    ``parts`` is an array of ``PART``. Null roles, texts and part lists read as
    empty. Turns go by number, nulls first; rows of the same number by role and
    content, and a repeated row is a turn of its own. An empty table gives no
    rows. Other columns are not read. A conversation is one output row, so its
    turns meet in one task; what meets is its own text only.
    """
    is_trained = F.coalesce(F.col(role) == trained_role, F.lit(False))
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    head = F.concat(F.lit(TURN), escape(F.coalesce(F.col(role), F.lit(""))), F.lit(SEP))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    body = F.transform(content, lambda p: F.struct(
        visit(p).alias("text"), (is_trained & ~F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False))).alias("loss")))
    segments = F.concat(F.array(plain(head)), body, F.array(plain(F.lit(END))))
    held = F.transform(
        F.filter(content, lambda p: p["kind"].isin(*PLACEHOLDERS)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    one = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), segments.alias("segments"),
        held.alias("held")).alias("one"))
    chats = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    flat = chats.select(
        F.col("conv_id").alias(conv), F.size("all").cast("bigint").alias("n_turns"),
        F.flatten("all.segments").alias("segments"), F.flatten("all.held").alias("held"))
    return flat.select(
        conv, "n_turns", F.array_join("segments.text", "").alias("formatted"), "segments",
        F.transform("held", lambda h, i: F.struct(
            i.alias("position"), h["kind"].alias("kind"), h["ref"].alias("ref"), h["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("held", F.lit(0).cast("bigint"), lambda total, h: total + h["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text as array of (role, text), escapes taken back; placeholders stay."""
    pieces = F.split(formatted, r"<\|turn\|>")  # nothing stands before the first mark
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.struct(
        restore(F.substring_index(p, SEP, 1)).alias("role"),
        restore(F.regexp_extract(p, r"(?s)^.*?<\|sep\|>(.*)<\|end\|>$", 1)).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, escapes taken back."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: restore(s["text"])), "")
