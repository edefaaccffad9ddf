"""Quality rules, line first: failing lines go, then documents that lost too much text.

Spark expressions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import words

#: The symbols counted, and phrases of boilerplate and navigation lines.
SYMBOLS = r"[#*$%&|<>]"
MARKS = "#*$%&|<>"
BOILERPLATE = (
    "(?i)lorem ipsum|enable javascript|javascript is (disabled|required)|cookie (policy|settings|consent)|"
    "we use cookies|privacy policy|terms of (use|service)|all rights reserved|licensed under|"
    "sign (in|up) (to|for)|subscribe to our|share this (post|page|article)|copyright ©|© \\d{4}"
)
NAVIGATION = r"^\s*(home|menu|next|previous|back|login|log in|search|skip to content|read more|click here)\s*$"
#: A line's last character, perhaps inside closing marks.
TERMINAL = r"""[.!?…。！？:;][)\]"'”’»\s]*$"""
#: A sentence that ends within the line.
SENTENCE = r"""[.!?…。！？][)\]"'”’»]*\s+\w"""


#: What parts sentences.
BETWEEN = r"(?<=[.!?…])\s+|(?<=[。！？])\s*"


def _mentions(line: Column) -> Column:
    """Whether sentences with phrases of boilerplate make up no more than half of a line."""
    held = F.filter(F.split(line, BETWEEN, -1), lambda x: x.rlike(BOILERPLATE))
    return 2 * F.length(F.array_join(held, "")) <= F.length(line)


def _passes(line: Column, boilerplate: Column, max_symbol_share: float, by_share: bool) -> Column:
    """``boilerplate``: whether the line holds a phrase of it. Cheap conditions come first."""
    chars = F.length(line)
    symbols = chars - F.length(F.translate(line, MARKS, ""))
    shouts = chars - F.length(F.replace(line, F.lit("!!"), F.lit("")))
    return (
        (symbols <= chars * max_symbol_share)
        & (shouts <= F.greatest(F.lit(4), chars * max_symbol_share))
        & ((~boilerplate | _mentions(line)) if by_share else ~boilerplate)
        & (line.rlike(TERMINAL) | line.rlike(SENTENCE))
        & ~F.lower(line).rlike(NAVIGATION)
    )


def repeated_window_words(at: Column, size: int) -> Column:
    """Number of words in windows found twice or more. ``at``: (digest, position) of the windows, sorted."""
    twin = lambda s, i: (s["h"] == F.get(at, i - 1)["h"]) | (s["h"] == F.get(at, i + 1)["h"])
    found = F.sort_array(F.transform(F.filter(at, lambda s, i: F.coalesce(twin(s, i), F.lit(False))), lambda s: s["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 30)).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(found, start, step, lambda acc: acc["n"])


def quality(docs: DataFrame, window: int = 5, min_words: int = 10, max_repeat_percent: int = 20, max_symbol_share: float = 0.08, max_loss: float = 0.6, by_share: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_removed, loss (share of the word characters in removed lines) and cleaned (the lines
    that pass, with the blank lines between them). A line passes if it ends in terminal
    punctuation or holds a whole sentence, has few symbols and no shouting, and is neither navigation nor boilerplate.
    A document is kept unless ``base_failed`` or ``loss > max_loss``; boilerplate alone doesn't
    count as loss. With ``by_share`` it does, and a line is boilerplate only if sentences with its phrases
    make up more than half of it, so prose that mentions one stays. Null text has no words, so it fails. Repeated rows are judged each by itself;
    other columns are ignored. Window digests are 64 bits wide and compared within one text only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("words", words(F.col("text"))).withColumn("lines", F.split("text", "\n", -1))
    n = F.size("words")
    full = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    seen = F.transform("lines", lambda x: F.struct(x.alias("x"), full(x).alias("full"), (full(x) & x.rlike(BOILERPLATE)).alias("boiler")))
    judge = lambda s: F.when(s["full"], _passes(s["x"], s["boiler"], max_symbol_share, by_share)).otherwise(True)
    df = df.withColumn("seen", seen).withColumn("judged", F.transform("seen", lambda s: F.struct(s["x"].alias("x"), s["full"].alias("full"), s["boiler"].alias("boiler"), judge(s).alias("ok"))))
    text_of = lambda s: s["x"]
    df = df.withColumn("full", F.transform(F.filter("judged", lambda s: s["full"]), text_of))
    digest = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(window)])
    df = df.withColumn("windows", F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), digest)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    sorted_windows = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.col("repeats"), sorted_windows))
    df = df.withColumn("passed", F.transform(F.filter("judged", lambda s: s["ok"]), text_of))
    df = df.withColumn("failed", F.transform(F.filter("judged", lambda s: ~s["ok"] if by_share else ~s["ok"] & ~s["boiler"]), text_of))
    bare = lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", ""))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", MARKS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("repeats"), repeated_window_words(F.col("sorted"), window)), F.lit(0)).cast("long").alias("n_repeat_words"),
        bare(F.array_join("failed", "")).alias("lost"),
        (F.size("lines") - F.size("passed")).cast("long").alias("n_lines_removed"),
        F.array_join("passed", "\n").alias("cleaned"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    loss = F.when(F.col("word_chars") > 0, F.col("lost") / F.col("word_chars")).otherwise(0.0)
    df = df.withColumn("base_failed", base).withColumn("loss", loss)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= max_loss)).drop("lost")
    # conditions are not pushed below an observation; pushed further, one on ``kept`` would write out
    # the expressions it is made of at every use, inside loops over words
    return df.observe(f"quality-{uuid.uuid4().hex}", F.count("*").alias("documents"), F.count_if("kept").alias("kept"))


def clean_documents(docs: DataFrame, **rules) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` that are kept, their text without the failing lines and
    n_chars, if there is one, made to fit. Boilerplate is judged by its share and counts as loss. Other
    columns come back as they are, whatever their names; null and empty texts go, repeated rows are
    judged each by itself."""
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    kept = quality(marked, **{"by_share": True} | rules).filter("kept").withColumnRenamed("doc_id", "_row")
    own["text"] = F.col("cleaned")
    if "n_chars" in own:
        own["n_chars"] = F.length("cleaned").cast("long")
    return kept.select(*[v.alias(k) for k, v in own.items()])
