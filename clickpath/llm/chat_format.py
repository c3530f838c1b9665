r"""Chat formatting in Spark expressions only.

The rows of a conversation are collected as turn structs and sorted; adjacent
turns of one role become one block, and the blocks are concatenated under a
template of the ``[INST]`` family::

    <s><<SYS>>\nsystem\n<</SYS>>\n\n[INST] user [/INST] assistant</s>

Parts of a merged block are set apart by ``[NEXT]``, so that turns can be told
apart again; roles other than system, user and assistant are written as
``[ROLE] name\ntext[/ROLE]``. A control string inside a text gets a backslash
after its first character (one more if it has some already), so a control
string in the output always is a mark of the template, and dropping one
backslash gives the text back.

Everything is linear in the length of a conversation: blocks are cut by the
positions where the role changes, no array or string grows step by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
NEXT = "[NEXT]"
#: Marks before and after a block of each role.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE] ", "[/ROLE]")
#: The role whose texts are under the loss mask.
LEARNED = "assistant"

_REST = r"/?s>|</?SYS>>|/?INST\]|/?ROLE\]|NEXT\]"
_CONTROL = rf"(<|\[)(\\*)({_REST})"
_ESCAPED = rf"(<|\[)\\(\\*)({_REST})"
_BLOCK_ENDS = r"(?<= \[/INST\])|(?<=</s>)|(?<=<</SYS>>\n\n)|(?<=\[/ROLE\])"


def escape(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_name(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_name(name: Column) -> Column:
    parts = F.split(unescape(name), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _mark(role: Column, side: int) -> Column:
    other = F.concat(F.lit(OTHER[0]), _escape_name(role), F.lit("\n")) if side == 0 else F.lit(OTHER[1])
    out = F.when(role == "system", F.lit(MARKS["system"][side]))
    for name in ("user", "assistant"):
        out = out.when(role == name, F.lit(MARKS[name][side]))
    return out.otherwise(other)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, segments)``: one row for each conversation of ``rows``.

    ``segments`` are ``(text, loss)`` pieces whose texts joined are
    ``formatted``; those with ``loss`` hold the escaped assistant texts and
    nothing else. Turns come in the order of their number, null numbers last,
    ties by role and text; repeated rows are repeated turns. Null roles and
    texts are empty; rows without a conversation id form one conversation
    with a null id. An empty table gives no rows; other columns are ignored,
    whatever their names. A conversation is one row of Spark, so it must stay
    below the 2 GB that Spark allows for one.
    """
    turn = F.struct(
        F.col(turn_col).isNull().alias("unnumbered"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    at = lambda k: F.get("turns", k)
    # a block starts where the role changes; the last bound closes the last block
    bounds = turns.select("conv_id", "turns", F.filter(F.sequence(F.lit(0), F.size("turns")), lambda k: (k == 0) | (k == F.size("turns")) | (at(k)["role"] != at(k - 1)["role"])).alias("bounds"))
    blocks = F.transform(
        F.slice("bounds", 1, F.size("bounds") - 1),
        lambda a, i: F.struct(at(a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, F.get("bounds", i + 1) - a), lambda t: t["text"]).alias("parts")),
    )

    def pieces(block: Column) -> Column:
        role = block["role"]
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.concat(
            F.flatten(F.transform(block["parts"], lambda t, i: F.array(
                piece(F.when(i == 0, _mark(role, 0)).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(t), role == LEARNED)))),
            F.array(piece(_mark(role, 1), F.lit(False))),
        )

    first = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    out = bounds.select("conv_id", blocks.alias("blocks")).select("conv_id", F.concat(first, F.flatten(F.transform("blocks", pieces))).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chats(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation."""
    blocks = F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), _BLOCK_ENDS), lambda b: b != "")
    inner = lambda b, marks: F.substr(b, F.lit(len(marks[0]) + 1), F.char_length(b) - len(marks[0]) - len(marks[1]))

    def turns(block: Column) -> Column:
        known = F.when(F.startswith(block, F.lit(MARKS["user"][0])), F.struct(F.lit("user").alias("role"), inner(block, MARKS["user"]).alias("text")))
        known = known.when(F.startswith(block, F.lit(MARKS["system"][0])), F.struct(F.lit("system").alias("role"), inner(block, MARKS["system"]).alias("text")))
        named = F.substring_index(inner(block, OTHER), "\n", 1)
        known = known.when(F.startswith(block, F.lit(OTHER[0])), F.struct(_unescape_name(named).alias("role"), F.substr(inner(block, OTHER), F.char_length(named) + 2).alias("text")))
        known = known.otherwise(F.struct(F.lit("assistant").alias("role"), inner(block, MARKS["assistant"]).alias("text")))
        # split() takes a pattern: the mark's brackets are escaped
        return F.transform(F.split(known["text"], r"\[NEXT\]"), lambda t: F.struct(known["role"].alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_report(rows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks)``, read back from :func:`format_chats`."""
    out = format_chats(rows)
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = out.select("conv_id", parse_chats(F.col("formatted")).alias("turns"), learned.alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    changes = F.size(F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda k: (k == 0) | (F.get("turns", k)["role"] != F.get("turns", k - 1)["role"])))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", changes.cast("long").alias("n_blocks"))
