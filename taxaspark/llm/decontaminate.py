"""Benchmark decontamination by a positional inverted index. Spark expressions only.

Texts are tokenised once; their terms by position are stored. Lists of a term's positions ("postings")
are looked up in the order of their length: a window of a test item can occur in a text only where its
rarest term occurs. So the number of occurrences of every test term is counted over the corpus, each
window is filed under its rarest term, and the postings of these terms are taken from the stored
positions together with the terms around them. The lists
of a window's other terms, shifted by their offsets, meet at such a posting exactly if the text
around it equals the window; terms in another order or with gaps give a proximity match.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import cut, in_blocks, lower_ascii, text_key, words

#: What separates words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a test-side table that are broadcast at once; larger tables go in blocks.
BLOCK_ROWS = 200_000


def tokens(text: Column) -> Column:
    return words(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, start, words) of every window of ``window`` words; shorter items are one window."""
    df = items.filter("item_id is not null").select("item_id", tokens(F.col("text")).alias("all")).filter(F.size("all") > 0)
    width = F.least(F.lit(window), F.size("all"))
    return df.select("item_id", "all", F.explode(F.sequence(F.lit(1), F.size("all") - width + 1)).alias("start"), width.alias("width")).select(
        "item_id", "start", F.slice("all", F.col("start"), F.col("width")).alias("words"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, tokens) of every row of ``docs(doc_id, text)``, stored: what stands where."""
    return cut(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), tokens(F.col("text")).alias("tokens")))


def term_counts(stored: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of each of ``terms(term)`` that occurs."""
    spread = stored.select(F.explode("tokens").alias("term"))
    return in_blocks(terms, ["term"], BLOCK_ROWS, lambda t: spread.join(F.broadcast(t), "term").groupBy("term").agg(F.count("*").alias("n")))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, entries): each window filed under its rarest term; entries hold item_id, back (words
    before the term) and words. Windows with a term that the corpus lacks are left out."""
    parts = windows.select("item_id", "words", F.posexplode("words").alias("back", "term")).join(counts, "term", "left")
    best = parts.groupBy("item_id", "words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "back", "term")).alias("at"))
    return best.filter("at.n > 0").groupBy(F.col("at.term").alias("term")).agg(
        F.collect_list(F.struct("item_id", F.col("at.back").alias("back"), "words")).alias("entries"))


def matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """As :func:`stored_matches`, in ``docs(doc_id, text)``."""
    return stored_matches(positions(docs), items, window, slop)


def stored_matches(stored: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """Matches of windows of ``items(item_id, text)`` in the texts of :func:`positions`, by posting.

    doc_id, text_key, term, pos (of the posting, from 0), phrases: array of (item_id, start, n),
    the windows that occur word for word with the place of their first word and their length;
    near: item_ids of windows all of whose terms lie within ``slop`` more places than the window
    is wide, in any order (empty where slop is None). Null texts and items without words match
    nothing; items without an item_id are ignored; repeated rows share doc_id and text_key and so
    give the same matches again.
    """
    windows = cut(item_windows(items, window).distinct())
    terms = cut(windows.select(F.explode("words").alias("term")).distinct())
    anchors = cut(rarest_terms(windows, cut(term_counts(stored, terms))))
    side = window - 1 + (slop or 0)

    def look_up(block: DataFrame) -> DataFrame:
        posting = stored.select("doc_id", "text_key", "tokens", F.posexplode("tokens").alias("pos", "term")).join(F.broadcast(block.select("term")), "term")
        first = F.greatest(F.col("pos") - side, F.lit(0))
        posting = posting.select("doc_id", "text_key", "term", "pos", (F.col("pos") - first).alias("before"), F.slice("tokens", first + 1, F.col("pos") - first + side + 1).alias("around"))
        # nothing is pushed below an observation: what leaves the loop over a text's words is a
        # posting with its surroundings, never a copy of the whole text
        posting = posting.observe(f"postings-{uuid.uuid4().hex}", F.count("*").alias("postings")).join(F.broadcast(block), "term")
        begins = lambda e: F.col("before") - e["back"]
        exact = lambda e: (begins(e) >= 0) & (F.slice("around", F.greatest(begins(e), F.lit(0)) + 1, F.size(e["words"])) == e["words"])
        found = F.transform(F.filter("entries", exact), lambda e: F.struct(e["item_id"].alias("item_id"), (F.col("pos") - e["back"]).alias("start"), F.size(e["words"]).alias("n")))
        near = F.array_distinct(F.transform(F.filter("entries", lambda e: F.size(F.array_except(e["words"], F.col("around"))) == 0), lambda e: e["item_id"]))
        out = posting.select("doc_id", "text_key", "term", "pos", found.alias("phrases"), (near if slop is not None else F.slice(near, 1, 0)).alias("near"))
        return out.filter((F.size("phrases") > 0) | (F.size("near") > 0))

    return in_blocks(anchors, ["term"], BLOCK_ROWS, look_up)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_key, n_words, n_hit (words inside an
    occurrence of a window), item_ids (as strings, sorted), contaminated."""
    stored = positions(docs)
    found = stored_matches(stored, items, window).select("doc_id", "text_key", "phrases")
    places = F.flatten(F.transform("phrases", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1)))
    hits = found.select("doc_id", "text_key", F.array_distinct(places).alias("places"), F.array_distinct(F.transform("phrases", lambda p: p["item_id"].cast("string"))).alias("items"))
    hits = hits.groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    base = stored.select("doc_id", "text_key", F.size("tokens").cast("long").alias("n_words"))
    joined = base.alias("b").join(hits.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("b.text_key") == F.col("h.text_key")), "left")
    n_hit = F.coalesce("h.n_hit", F.lit(0).cast("long"))
    return joined.select("b.doc_id", "b.text_key", "b.n_words", n_hit.alias("n_hit"), F.coalesce("h.item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Rows of ``docs(doc_id, text, ...)`` in which no window of an item occurs, with all their columns,
    whatever their names. Null and empty texts stay; so do repeated rows, as often as they come."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hit = matches(docs.select("doc_id", "text"), items, window).select(F.struct("doc_id", "text_key").alias("hit")).distinct()
    kept = rows.join(hit, F.col("row.doc_id").eqNullSafe(F.col("hit.doc_id")) & (text_key(F.col("row.text")) == F.col("hit.text_key")), "left_anti")
    return kept.select("row.*")
