"""Chat formatting from relational operations only: sort, merge, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
ROLE, ROLE_END, TURN = "[ROLE]", "[/ROLE]", "[TURN]"

#: Control strings of this and of related templates; in texts they never stay bare.
_NAMES = r"(/?(?:s>|INST\]|ROLE\]|TURN\]|SYS>))"


def escape(text: Column) -> Column:
    r"""Puts one more backslash behind the bracket of each control string: ``</s>`` becomes ``<\/s>``."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _NAMES, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Inverse of escape."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _NAMES, r"$1$2$3")


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, formatted, segments (array of text and loss flag; their
    concatenation is formatted).

    turns has key, turn, role, text; other columns are ignored. Turns are sorted by turn, then
    role, then text, so ties and repeated rows have one defined order. Null turns come first;
    null roles and texts count as empty; a null key is a conversation of its own. An empty table
    gives no rows. Adjacent turns of a role share one block, whose turns are parted by [TURN].
    Only assistant texts lie under the loss mask. A conversation is one row by definition, so
    its turns are gathered in one place.
    """
    empty = F.lit("")
    collected = turns.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text")))).alias("turns"))
    # The first turn of each block: those whose role is not the one before.
    starts = collected.select(key, "turns", F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i).role != F.element_at("turns", F.greatest(i - 1, F.lit(1))).role),
    ).alias("starts"))
    blocks = starts.select(key, F.transform("starts", lambda s, k: F.struct(
        F.element_at("turns", s).role.alias("role"),
        F.transform(
            F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s),
            lambda t: t.text).alias("texts"))).alias("blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def spread(block: Column) -> Column:
        head = F.array(segment(F.concat(F.lit(ROLE), escape(block.role), F.lit(ROLE_END)), F.lit(False)))
        body = F.flatten(F.transform(block.texts, lambda t, k: F.array(
            segment(F.when(k > 0, F.lit(TURN)).otherwise(empty), F.lit(False)),
            segment(escape(t), block.role == "assistant"))))
        return F.concat(head, body, F.array(segment(F.lit(END), F.lit(False))))

    segments = blocks.select(key, F.concat(
        F.array(segment(F.lit(BEGIN), F.lit(False))), F.flatten(F.transform("blocks", spread))).alias("segments"))
    return segments.select(
        key, F.concat_ws("", F.transform("segments", lambda s: s.text)).alias("formatted"), "segments")


def read_chats(formatted: Column) -> Column:
    """Array of (role, text) read from formatted text."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    blocks = F.filter(F.split(body, END), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, r"\[/ROLE\]")
        role = unescape(F.substring(F.get(parts, 0), len(ROLE) + 1, 2**31 - 1))
        return F.transform(F.split(F.get(parts, 1), r"\[TURN\]"),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest_chats(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and digests of format_chats' output, read back from it."""
    read = chats.select(
        key, "formatted", read_chats(F.col("formatted")).alias("read"),
        F.concat_ws("", F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text))).alias("loss"))
    return read.select(
        key, F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform(
            "read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
