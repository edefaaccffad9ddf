"""Chat formatting with Spark expressions only.

A conversation becomes one string of turns, `<turn:ROLE>TEXT</turn>` and a line feed each. Adjacent
turns of one role share a turn, their texts parted by `<part>`. `&`, `<` and `>` inside roles and
texts are escaped, so a text that spells a control string cannot end a turn and the string can be
read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END, PART = "<turn:", ">", "</turn>\n", "<part>"
#: What stands for a control character, the escape character itself first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to one row per conv_id: conv_id, segments, formatted.

    segments: array of (text, loss) whose texts joined are ``formatted``; ``loss`` marks the texts of
    ``loss_roles``, without their control strings. Turns are sorted by turn, then role, then text
    (ties and repeated rows stay, each as a turn or part); a null turn comes first, null roles and
    texts count as empty, a null conv_id is a conversation like others. Other columns are ignored.
    """
    blank = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).alias("t"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        joined = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        ends = F.get("turns", i + 1)["role"]
        opens = F.when(joined, F.lit(PART)).otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT)))
        shuts = F.when(ends.isNotNull() & (ends == t["role"]), blank).otherwise(F.lit(END))
        marks = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(marks(opens, F.lit(False)), marks(escape(t["text"]), t["role"].isin(*loss_roles)), marks(shuts, F.lit(False)))

    segments = F.flatten(F.transform("turns", pieces)).cast(SEGMENTS)
    df = df.select("conv_id", F.filter(segments, lambda s: s["text"] != "").alias("segments"))
    return df.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from the string, one for each row that went in."""
    blocks = F.array_remove(F.split(formatted, END.strip() + r"\n"), "")

    def one(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(OPEN) + 1, 2**31 - 1), SHUT, 1)
        body = F.substring(block, F.length(role) + (len(OPEN) + len(SHUT) + 1), F.length(block))
        return F.transform(F.split(body, PART, -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, one))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
