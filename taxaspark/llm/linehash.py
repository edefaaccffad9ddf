"""Substring dedup by hashed lines or paragraphs.

Units of all documents are normalised and digested; digests are grouped globally, the unit of the
smallest (doc_id, position) stays and the others are removed. Only digests that occur twice or
more leave the first grouping, and texts are not shuffled with it: each document meets its own
list of removed units at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import parts, text_key

#: What parts units of a kind.
PARTS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[\x20\x09]*\n\s*")}
SPACES = re.compile(r"\s+")


def split_units(text: str, kind: str) -> list[tuple[int, int]]:
    """(start, end) of each unit, in code points, end exclusive and without the separator."""
    found, at = [], 0
    for m in PARTS[kind].finditer(text):
        found.append((at, m.start()))
        at = m.end()
    found.append((at, len(text)))
    return found


def normalise(unit: str) -> str:
    return SPACES.sub(" ", unit).strip().lower()


def units(docs: DataFrame, kind: str = "line", min_words: int = 5) -> DataFrame:
    """(doc_id, text_key, pos, start, end, digest) of every unit with ``min_words`` words or more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 2):
                rows = []
                for i, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    for pos, (a, b) in enumerate(split_units(text or "", kind)):
                        unit = normalise(text[a:b]) if b > a else ""
                        if unit.count(" ") + 1 >= min_words and unit:
                            rows.append((i, key, pos, a, b, hashlib.md5(unit.encode()).digest()))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "text_key", "pos", "start", "end", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(of, "doc_id long, text_key long, pos int, start long, end long, digest binary")


def repeated_units(docs: DataFrame, kind: str = "line", min_words: int = 5) -> DataFrame:
    """Units that are not the first of their digest: (doc_id, text_key, pos, start, end, first_doc,
    first_pos)."""
    found = units(docs.filter("doc_id is not null"), kind, min_words).distinct()
    place = F.struct("doc_id", "text_key", "pos")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = found.join(first, "digest").filter(place > F.col("first"))
    return later.select("doc_id", "text_key", "pos", "start", "end", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def without_spans(text: str, spans: list[tuple[int, int]], kind: str) -> str:
    """``text`` without ``spans``, sorted and disjoint units, each with the separator after it; after a
    last unit that goes, the separator before it goes too if it parts paragraphs."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        gone = PARTS[kind].match(text, end)
        at = gone.end() if gone else end
        if not gone and kind != "line":
            kept[-1] = kept[-1].rstrip()
    return "".join(kept) + text[at:]


def cut_spans(text: Column, spans: Column, kind: str = "line") -> Column:
    def of(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
            out.append(text if text is None or not found else without_spans(text, [(s["start"], s["end"]) for s in found], kind))
        return pa.array(out, pa.string())

    return F.arrow_udf(of, "string")(text, spans)


def substring_dedup(docs: DataFrame, kind: str = "line", min_words: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text, removed, first_docs, deduped.

    removed: sorted array of (start, end) in the original text's code points; first_docs: ids of
    the documents whose units were kept instead; deduped: the text without them. Units of fewer
    than ``min_words`` words, empty texts and null texts stay as they are; a unit that repeats
    within one document loses its later places too. Rows with one doc_id and text are one
    document, returned as often as they come. Rows with a null doc_id are returned unchanged.
    """
    spans = repeated_units(docs, kind, min_words).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"),
        F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed", "first_docs")
    df = docs.select("doc_id", "text").join(spans, (F.col("doc_id") == F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    df = df.select("doc_id", "text", F.coalesce("removed", none).alias("removed"), F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"))
    return df.withColumn("deduped", cut_spans(F.col("text"), F.col("removed"), kind))
