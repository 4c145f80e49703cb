"""Preference pairs: the turns two conversations share are the prompt, the rest are completions.

Conversations are rendered turn by turn.  The longest common turn prefix of the chosen and the
rejected one is rendered once; what follows in each is a completion, with the spans of its
text that the loss counts (what the assistant says, and the end of its turn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is its header, its text and the mark of its end.
HEADER, END = ("<|", "|>\n"), "<|end|>\n"


def _plain(column: str) -> str:
    """SQL: a role or text in which nothing reads as a mark: a blank parts what would open one."""
    return f"replace({column}, '<|', '< |')"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order, of which one conversation is one row."""
    rows = turns.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    return rows.where("id is not null").groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{HEADER[0]}', {_plain("t.role")}, '{HEADER[1]}', {_plain("t.text")}, '{END}')), '')".replace("\n", "\\n")


def _spans(turns: str, role: str) -> str:
    """SQL: [begin, end) of the text and end mark of a role's turns, in characters of the rendering."""
    head = f"(length({_plain("t.role")}) + {len(HEADER[0]) + len(HEADER[1])})"
    size = f"({head} + length({_plain("t.text")}) + {len(END)})"
    empty = "cast(array() as array<struct<begin: bigint, end: bigint>>)"
    add = f"if(t.role = '{role}', concat(a.spans, array(struct(a.at + {head} as begin, a.at + {size} as end))), a.spans)"
    return f"aggregate({turns}, struct(0L as at, {empty} as spans), (a, t) -> struct(a.at + {size} as at, {add} as spans), a -> a.spans)"


def preference_pairs(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", role: str = "assistant") -> DataFrame:
    """One row per pair of pairs (chosen_id, rejected_id): the ids, n_common, prompt, chosen and
    rejected (completions), chosen_mask and rejected_mask (arrays of begin and end).

    Turns are in the order of turn, role and text; a null turn comes first, a null role or text
    is empty, rows that repeat are turns of their own.  Rows without a conversation id belong to
    none.  Conversations that are equal have empty completions; one that is the other's prefix
    has one.  Pairs of an unknown or null id are left out.  ``<|`` within a role or text is
    written ``< |``, so that no text forges a turn; turns are compared as they are.  Texts may
    be of any length.  Other columns are ignored; empty tables give an empty result.
    """
    told = conversations(turns, id_col, turn_col, role_col, text_col)
    both = pairs.join(told.select(F.col("id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id").join(told.select(F.col("id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id")
    first = "array_position(zip_with(c, r, (x, y) -> x.role <=> y.role and x.text <=> y.text), false)"
    counted = both.select("chosen_id", "rejected_id", "c", "r", F.expr(f"cast(if({first} = 0, size(c), {first} - 1) as int)").alias("n"))
    split = counted.select("chosen_id", "rejected_id", F.col("n").cast("long").alias("n_common"), F.expr("slice(c, 1, n)").alias("p"), F.expr("slice(c, n + 1, greatest(size(c) - n, 0))").alias("c"), F.expr("slice(r, n + 1, greatest(size(r) - n, 0))").alias("r"))
    made = [F.expr(_rendered(x)).alias(name) for x, name in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))]
    masks = [F.expr(_spans(x, role)).alias(f"{name}_mask") for x, name in (("c", "chosen"), ("r", "rejected"))]
    return split.select("chosen_id", "rejected_id", "n_common", *made, *masks)


def neighbours(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs of a table whose conversations come two by two: 2k is chosen, 2k + 1 rejected."""
    ids = turns.select(F.col(id_col).alias("chosen_id")).where("chosen_id % 2 = 0").distinct()
    return ids.select("chosen_id", (F.col("chosen_id") + 1).alias("rejected_id"))
