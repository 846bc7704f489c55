"""Chat formatting with Spark expressions only: turns of a conversation are collected as structs and sorted, adjacent
turns of one role are merged by array aggregation, and the pieces are concatenated.

Template: a message is ``### <Role>: <text></turn>\n``, where further texts of the same role follow after ``</part>``.
Within roles and texts ``\\`` becomes ``\\e``, ``###`` becomes ``\\h``, ``</turn>`` ``\\t`` and ``</part>`` ``\\p`` (and in
roles ``: `` ``\\c``), so each control string in the output is one of the template's, and the codes read back exactly.

The loss mask is a list of (skip, take) lengths in characters: all and only the assistant's texts are taken.

Defined cases: null texts and null roles count as empty; rows of one turn number are ordered by role, then text; a null
conversation id is a conversation of its own; an empty table gives an empty result; other columns are ignored.  A
conversation is one row of the output, so it has to stay below the 2 GB that a Spark value can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, PART = "### ", "</turn>\n", "</part>"
CODES = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in CODES[::-1]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, loss_role: str = "assistant", key: str = "conv_id") -> DataFrame:
    """One row for each conversation: key, formatted (string), loss_mask (array of (skip, take) in characters)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = turns.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    head = lambda r: F.concat(F.lit(OPEN), F.replace(escape(r), F.lit(": "), F.lit("\\c")), F.lit(": "))
    # a merged turn begins where the role differs from that of the row before
    rows = rows.select(
        key,
        F.transform(
            "rows",
            lambda x, i: F.struct(
                x["role"].alias("role"),
                escape(x["text"]).alias("text"),
                F.when(i == 0, F.lit(True)).otherwise(F.col("rows")[F.greatest(i - 1, F.lit(0))]["role"] != x["role"]).alias("first"),
            ),
        ).alias("rows"),
    )
    n = F.size("rows")
    rows = rows.select(
        key,
        F.transform(
            "rows",
            lambda x, i: F.struct(
                F.when(x["first"], F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), head(x["role"]))).otherwise(F.lit(PART)).alias("lead"),
                x["text"].alias("text"),
                F.when(i == n - 1, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
                (x["role"] == F.lit(loss_role)).alias("loss"),
            ),
        ).alias("rows"),
    )
    formatted = F.array_join(F.transform("rows", lambda x: F.concat(x["lead"], x["text"], x["tail"])), "")
    lengths = F.transform("rows", lambda x: F.struct(
        (F.length(x["lead"]) + F.when(x["loss"], F.lit(0)).otherwise(F.length(x["text"]))).cast("long").alias("skip"),
        F.when(x["loss"], F.length(x["text"])).otherwise(F.lit(0)).cast("long").alias("take"),
        F.length(x["tail"]).cast("long").alias("after")))
    return rows.select(key, formatted.alias("formatted"), F.transform(lengths, lambda x: F.struct(x["skip"].alias("skip"), x["take"].alias("take"))).alias("loss_mask"))


def read_chats(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read back from the output: key, formatted, turns (array of (role, text), one for each input row), loss_text.

    The output is split once into its messages and texts; the mask's lengths, one for each text, are laid on the pieces
    (what stands before a text, and the text), so the time is in proportion to the conversation's length.  A mask that
    does not fit the pieces is an error.
    """
    messages = F.filter(F.split("formatted", CLOSE, -1), lambda m: m != F.lit(""))
    head = lambda m: F.substring_index(F.substr(m, F.lit(len(OPEN) + 1)), ": ", 1)
    parts = F.transform(messages, lambda m, i: F.struct(
        head(m).alias("role"), (F.when(i > 0, F.lit(len(CLOSE))).otherwise(F.lit(0)) + len(OPEN) + F.length(head(m)) + 2).alias("lead"),
        F.split(F.substr(m, F.lit(len(OPEN) + 3) + F.length(head(m))), PART, -1).alias("texts")))
    role = lambda m: unescape(F.replace(m["role"], F.lit("\\c"), F.lit(": ")))
    pieces = F.flatten(F.transform(parts, lambda m: F.transform(m["texts"], lambda t, i: F.struct(
        role(m).alias("role"), F.when(i == 0, m["lead"]).otherwise(F.lit(len(PART))).alias("lead"), t.alias("text")))))
    split = chats.select(key, "formatted", "loss_mask", pieces.alias("pieces"))
    turns = F.transform("pieces", lambda p: F.struct(p["role"].alias("role"), unescape(p["text"]).alias("text")))
    # a piece of the mask ends where its text ends, and takes the whole text or nothing
    fits = lambda p, m: (m["skip"] + m["take"] == p["lead"] + F.length(p["text"])) & ((m["take"] == 0) | (m["skip"] == p["lead"]))
    taken = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(fits(p, m), F.when(m["take"] > 0, unescape(p["text"])).otherwise(F.lit(""))).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")).cast("string")))
    return split.select(key, "formatted", turns.alias("turns"), F.array_join(taken, "").alias("loss_text"))
