"""BM25 full-text search over the columns of a table.

One query over a table is one scan: each row counts the query's terms in its own words, and only
numbers of rows and mean lengths are aggregated. For many queries an index is stored, see ``textindex``.
Words are cut by native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys
from taxaspark.operators import textindex
from taxaspark.operators.textindex import StoredIndex, part

#: Rows that are sent to the tasks at most; a longer list of hits is joined by a shuffle.
FEW = 10_000
#: Accented letters and what they are folded to; frequent words that aren't indexed.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


#: The columns of occurrence records that are searched.
OCCURRENCE_COLUMNS = (
    "species", "genus", "family", "order", "vernacularName", "sex", "lifeStage", "continent", "island", "countryCode", "stateProvince", "county", "municipality", "locality",
    "verbatimLocality", "level1Name",
)
Stem = Callable[[Column], Column]


def tokens(text: Column, stem: Stem | None = None) -> Column:
    """Lower-case words of a-z once accents are stripped, without stop words; ``stem`` maps a word to
    its stem by Spark expressions."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS)
    words = F.filter(F.split(folded, "[^a-z]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(words, stem) if stem else words


def query_terms(query: str) -> list[str]:
    folded = query.lower().translate(str.maketrans(*ACCENTS))
    return sorted({w for w in re.split("[^a-z]+", folded) if w and w not in STOP_WORDS})


@dataclass
class TextIndex:
    postings: DataFrame  # id, field, term, tf
    lengths: DataFrame  # id, field, len
    stem: Stem | None = None


def build_fts(df: DataFrame, key: str, columns: Iterable[str], stem: Stem | None = None) -> TextIndex:
    """Index of the given columns; ``key`` identifies a row. A query's terms are stemmed as it is."""
    spread = df.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), tokens(F.col(f"`{c}`"), stem).alias("words")) for c in columns])).alias("f"))
    spread = spread.select("id", "f.field", "f.words")
    words = spread.select("id", "field", F.explode("words").alias("term"))
    return TextIndex(words.groupBy("id", "field", "term").agg(F.count("*").alias("tf")), spread.select("id", "field", F.size("words").alias("len")), stem)


def store_fts(df: DataFrame, key: str, columns: Iterable[str], path: str, stem: Stem | None = None, overwrite: bool = False) -> StoredIndex:
    """Store an index of the columns below a path and open it. One that is there stays unless ``overwrite``."""
    spark = df.sparkSession
    if not overwrite:
        try:
            return open_fts(spark, path, stem)
        except AnalysisException:  # none there
            pass
    return textindex.store(df, key, columns, path, lambda text: tokens(text, stem), stem)


def open_fts(spark: SparkSession, path: str, stem: Stem | None = None) -> StoredIndex:
    return textindex.open_index(spark, path, stem)


def bm25(index: TextIndex | StoredIndex, query: str, fields: Iterable[str] | None = None) -> DataFrame:
    """(id, score) of the rows that hold any term of the query; frequencies, lengths and the number
    of rows with a term are taken over the chosen fields."""
    if isinstance(index, StoredIndex):
        return textindex.scores(index, query_terms(query), fields)
    chosen = F.col("field").isin(*fields) if fields is not None else F.lit(True)
    lengths = index.lengths.filter(chosen).groupBy("id").agg(F.sum("len").alias("len"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    wanted = F.array_contains(tokens(F.lit(query), index.stem), F.col("term")) if index.stem else F.col("term").isin(*query_terms(query))
    hits = index.postings.filter(chosen & wanted).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most the query's terms
    joined = hits.join(F.broadcast(df), "term").join(lengths, "id").crossJoin(F.broadcast(totals))  # totals: one row
    return joined.groupBy("id").agg(F.sum(part(F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("mean"))).alias("score"))


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def scan_scores(df: DataFrame, key: str, columns: Iterable[str], query: str) -> DataFrame:
    """As :func:`bm25` of an index of the columns, without one: no word is exploded or shuffled.
    ``key`` must identify a row."""
    terms = query_terms(query)
    words = tokens(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]))
    rows = df.select(F.col(key).alias("id"), F.explode(F.array(words)).alias("words"))  # one; no condition on the words passes it
    counts = rows.select("id", F.size("words").alias("len"), *[_times(F.col("words"), t).alias(f"tf{k}") for k, t in enumerate(terms)])
    ends = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    held = reduce(lambda a, k: a | (F.col(f"tf{k}") > 0), range(len(terms)), F.lit(False))
    parts = [part(F.col(f"tf{k}"), F.col(f"df{k}"), F.col("n"), F.col("len"), F.col("mean")) for k in range(len(terms))]
    return counts.filter(held).crossJoin(F.broadcast(ends)).select("id", reduce(add, parts, F.lit(0.0)).alias("score"))  # ends: one row


def fts_search(df: DataFrame, key: str, columns: list[str], query: str, unique: bool = True, limit: int = 100, index: StoredIndex | None = None) -> DataFrame:
    """Ranked rows: (species, id, score, matched_fields); of a stored index where one is given.

    ``unique`` takes the best row of each species before the limit, of equal ones that of the least
    id. Blank species are dropped after it, so fewer rows may come; names are given as keys. Texts
    are read for the rows that are given only.
    """
    names = df.select(F.col(key).alias("id"), F.col("species").alias("group"))
    if index is None:
        scored = scan_scores(df, key, columns, query)
    else:
        scored = textindex.best_rows(index, query_terms(query), limit, columns, names if unique else None)
    if unique:
        best = names.join(scored, "id").groupBy("group").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("r"))
        scored = best.select("r.*")
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    rows = df.select(F.col(key).alias("id"), *[c for c in dict.fromkeys(["species", *columns]) if c != key])
    rows = rows.join(F.broadcast(top) if limit <= FEW else top, "id").orderBy(F.desc("score"), "id")
    fields = exprs.token_matched_fields([c for c in columns if c in rows.columns], query)
    return rows.filter(exprs.not_blank(F.col("species"))).select(keys.underscore_key(F.trim("species")).alias("species"), "id", exprs.rounded_score(F.col("score")).alias("score"), fields.alias("matched_fields"))


def search_occurrences(df: DataFrame, query: str, key: str, limit: int = 100, index: StoredIndex | None = None) -> DataFrame:
    """Species by any searched column of occurrence records, best first; nothing for an empty query."""
    found = fts_search(df, key, [c for c in OCCURRENCE_COLUMNS if c in df.columns], query.strip(), limit=limit, index=index)
    return found if query.strip() else found.limit(0)
