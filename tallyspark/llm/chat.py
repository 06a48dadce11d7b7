"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Each assistant turn becomes an example of its own: all turns before it are context, and only its reply is
trainable. Turns after the last reply make one more example with nothing to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: START role SEP text END, where role and text are escaped.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
OPEN, ESCAPED = "<|", "<\\|"


def escape(text: Column) -> Column:
    """No control string is left: backslashes double, then "<|" gets one inside."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), context, target. The text to train on is context + target, its loss mask covers target.

    A target is the escaped reply and END; the last example of a conversation that doesn't end with a reply has
    an empty target and all turns as context. Null texts and roles are empty, null turns come first; rows with the
    same turn go by role, then text; repeated rows stay. Rows with a null conversation are one conversation.
    Other columns are ignored. One shuffle, of the turns; a conversation is gathered whole, as its examples need it.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)))
    bodies = F.transform("turns", lambda t: F.concat(escape(t["text"]), F.lit(END)))
    whole = whole.select("conv_id", heads.alias("heads"), bodies.alias("bodies"), F.transform("turns", lambda t: t["role"] == target).alias("is_target"))
    n = F.size("heads")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: F.when(i < n, F.get("is_target", i)).otherwise(~F.element_at("is_target", -1)))
    rows = whole.select("*", F.posexplode(places).alias("example", "at"))
    before = F.transform(F.slice(F.arrays_zip("heads", "bodies"), F.lit(1), F.col("at")), lambda t: F.concat(t["heads"], t["bodies"]))
    return rows.select(
        "conv_id",
        "example",
        F.concat(F.array_join(before, ""), F.when(F.col("at") < n, F.get("heads", F.col("at"))).otherwise("")).alias("context"),
        F.when(F.col("at") < n, F.get("bodies", F.col("at"))).otherwise("").alias("target"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its formatted examples alone: turns (role, text), replies under the loss mask in order, formatted_chars.

    The longest example holds all turns; aggregates combine in the map tasks.
    """
    whole = examples.groupBy("conv_id").agg(
        F.max_by(F.concat("context", "target"), "example").alias("full"),
        F.array_sort(F.collect_list(F.struct("example", "target"))).alias("targets"),
        F.sum(F.char_length("context") + F.char_length("target")).alias("formatted_chars"),
    )
    marked = F.filter(F.split("full", r"<\|im_end\|>", -1), lambda x: x != "")
    turn = F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, F.lit(len(START) + 1), F.char_length(x)), SEP, 1)).alias("role"),
            unescape(F.substring_index(x, SEP, -1)).alias("text"),
        ),
    )
    replies = F.transform(F.filter("targets", lambda t: t["target"] != ""), lambda t: unescape(F.substring(t["target"], F.lit(1), F.char_length(t["target"]) - len(END))))
    return whole.select("conv_id", turn.alias("turns"), replies.alias("replies"), "formatted_chars")
