"""A stored text index: statistics, and postings in blocks that carry a bound of their score.

Rows are dealt to blocks by a hash of their id, about ``BLOCK`` to each, so a block has one row of
postings for each term and field, however frequent the term. Each keeps its largest term frequency
and its shortest text: no posting of it scores more than these two together would. A search for the
best k rows first scores the few blocks whose bounds are highest; blocks that can't reach the k-th of
those scores are left out. Nothing of the corpus is counted when a query comes.

Below the index's path: ``postings`` sorted by term, ``terms`` (rows with the term), ``lengths`` of
texts, ``fields`` (number of rows, total length). The field "" stands for all columns together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.sources.stored import file_system

K1, B = 1.2, 0.75
#: Rows of a block, about; blocks that are scored to find out what a row must score.
BLOCK, SEEDS = 1024, 16
#: What a bound allows for sums in another order.
SLACK = 1 + 1e-9
ALL = ""

Stem = Callable[[Column], Column]


def part(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    """What a term adds to a row's score. Grows with tf, falls with length."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    stem: Stem | None = None

    @property
    def postings(self) -> DataFrame:
        """field, term, block, n, max_tf, min_len, entries array<struct<id, tf, len>>."""
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")

    @property
    def fields(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fields")

    def field(self, chosen: Iterable[str] | None) -> str | None:
        """The stored field for chosen columns; None if several but not all are chosen."""
        chosen = set(self.columns if chosen is None else chosen)
        if chosen >= set(self.columns):
            return self.columns[0] if len(self.columns) == 1 else ALL
        return chosen.pop() if len(chosen) == 1 else None


def open_index(spark: SparkSession, path: str, stem: Stem | None = None) -> StoredIndex:
    fields = spark.read.parquet(f"{path}/fields").select("field").collect()  # one row for each column
    return StoredIndex(spark, path, tuple(sorted(r["field"] for r in fields if r["field"] != ALL)), stem)


def _grouped(rows: pa.Table) -> pa.Table:
    """Postings of a block's field from its rows (id, block, field, words). Those of the null term are all
    rows, also those without words, with their lengths."""
    field, block = rows["field"][0], rows["block"][0]
    rows = rows.select(["id", "words"]).take(pc.sort_indices(rows["id"], null_placement="at_start")).combine_chunks()
    ids, words = (pa.concat_arrays(rows[c].chunks) for c in ("id", "words"))
    length = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    real = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), length)
    found, tf = np.unique((code * len(ids) + row)[real], return_counts=True)
    term, row = (np.concatenate(x) for x in zip(np.divmod(found, len(ids)), (np.full(len(ids), len(coded.dictionary)), np.arange(len(ids))), strict=True))
    tf = np.concatenate([tf, np.ones(len(ids), np.int64)])
    start = np.flatnonzero(np.diff(term, prepend=-1))
    end = np.append(start[1:], len(term))
    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]).take(pa.array(term[start]))
    entries = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length[row], pa.int32())], ["id", "tf", "len"])
    columns = {
        "field": pa.repeat(field, len(start)), "term": names, "block": pa.repeat(block, len(start)), "n": pa.array(end - start), "max_tf": pa.array(np.maximum.reduceat(tf, start), pa.int32()),
        "min_len": pa.array(np.minimum.reduceat(length[row], start), pa.int32()), "entries": pa.ListArray.from_arrays(pa.array(np.append(start, len(term)), pa.int32()), entries),
    }
    return pa.table(columns)


def store(df: DataFrame, key: str, columns: Iterable[str], path: str, words: Callable[[Column], Column], stem: Stem | None = None) -> StoredIndex:
    """Write the index of ``columns`` of ``df``, whose rows ``key`` identifies, in place of what is there.

    ``words`` gives a text's terms, once. Rows are dealt out by block and field, which hold about
    ``BLOCK`` of them however frequent a term, and a block's postings are made in one go. They are
    stored before they are sorted: the sort reads them twice.
    """
    columns, spark = tuple(columns), df.sparkSession
    n = df.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    block = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - bits) if bits else F.lit(0).cast("long")
    texts = [F.struct(F.lit(c).alias("field"), words(F.col(f"`{c}`")).alias("words")) for c in columns]
    if len(columns) > 1:
        texts.append(F.struct(F.lit(ALL).alias("field"), F.flatten(F.array(*[t["words"] for t in texts])).alias("words")))
    spread = df.select(F.col(key).alias("id"), block.alias("block"), F.explode(F.array(*texts)).alias("f")).select("id", "block", "f.field", "f.words")
    kind = spread.schema["id"].dataType.simpleString()
    blocks = spread.groupBy("block", "field").applyInArrow(_grouped, f"field string, term string, block long, n long, max_tf int, min_len int, entries array<struct<id:{kind},tf:int,len:int>>")
    blocks.write.mode("overwrite").parquet(f"{path}/grouped")
    grouped = spark.read.schema(blocks.schema).parquet(f"{path}/grouped")
    held = grouped.filter("term IS NULL").select("field", F.explode("entries").alias("e"))
    held.select("e.id", "field", "e.len").write.mode("overwrite").parquet(f"{path}/lengths")
    index = StoredIndex(spark, path, columns, stem)
    index.lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total")).write.mode("overwrite").parquet(f"{path}/fields")
    order = ["term", "field", "block"]
    grouped.filter("term IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    fs, where = file_system(spark, f"{path}/grouped")
    fs.delete(where, True)
    index.postings.groupBy("term", "field").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return index


def wanted(index: StoredIndex, terms: list[str]) -> Column:
    """Whether a row of the index is of one of the terms; reaches the scan as a filter."""
    if index.stem is None:
        return F.col("term").isin(*terms)
    return F.array_contains(F.array(*[index.stem(F.lit(t)) for t in terms]), F.col("term")) if terms else F.lit(False)


def _hits(index: StoredIndex, terms: list[str], field: str) -> DataFrame:
    """Postings of the terms with their number of rows and the field's statistics, both a few rows."""
    mine = F.col("field") == field
    df = index.terms.filter(mine & wanted(index, terms)).select("term", "df")
    field_row = index.fields.filter(mine).select(F.col("n").alias("rows"), (F.col("total") / F.col("n")).alias("mean"))
    blocks = index.postings.filter(mine & wanted(index, terms))
    return blocks.join(F.broadcast(df), "term").crossJoin(F.broadcast(field_row))  # at most the query's terms; one row


def _scores(blocks: DataFrame) -> DataFrame:
    each = blocks.select("term", "df", "rows", "mean", F.explode("entries").alias("e"))
    add = part(F.col("e.tf"), F.col("df"), F.col("rows"), F.col("e.len"), F.col("mean"))
    return each.select(F.col("e.id").alias("id"), add.alias("part")).groupBy("id").agg(F.sum("part").alias("score"))


def scores(index: StoredIndex, terms: list[str], fields: Iterable[str] | None = None) -> DataFrame:
    """(id, score) of all rows with a term. For several but not all columns, frequencies and lengths
    are put together from those of each."""
    field = index.field(fields)
    if field is not None:
        return _scores(_hits(index, terms, field))
    chosen = F.col("field").isin(*fields)
    total = index.fields.filter(chosen).agg(F.max("n").alias("rows"), (F.sum("total") / F.max("n")).alias("mean"))
    one = index.postings.filter(chosen & wanted(index, terms)).select("term", F.explode("entries").alias("e"))
    held = one.groupBy("term", F.col("e.id").alias("id")).agg(F.sum("e.tf").alias("tf"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))  # at most the query's terms
    lengths = index.lengths.filter(chosen).groupBy("id").agg(F.sum("len").alias("len"))
    joined = held.join(F.broadcast(df), "term").join(lengths, "id").crossJoin(F.broadcast(total))  # total: one row
    return joined.groupBy("id").agg(F.sum(part(F.col("tf"), F.col("df"), F.col("rows"), F.col("len"), F.col("mean"))).alias("score"))


def bounds(index: StoredIndex, terms: list[str], fields: Iterable[str] | None = None) -> DataFrame:
    """(block, bound): no row of a block scores more. Reads no entries."""
    field = index.field(fields)
    if field is None:
        raise ValueError("bounds are of one column or of all")
    most = part(F.col("max_tf"), F.col("df"), F.col("rows"), F.col("min_len"), F.col("mean"))
    return _hits(index, terms, field).select("block", most.alias("most")).groupBy("block").agg((F.sum("most") * SLACK).alias("bound"))


def open_blocks(index: StoredIndex, terms: list[str], k: int, fields: Iterable[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(block) of those that can hold one of the k best rows, or with ``groups(id, group)`` the best
    row of one of the k best groups."""
    field, bound = index.field(fields), bounds(index, terms, fields)
    first = bound.orderBy(F.desc("bound"), "block").limit(SEEDS)
    seeds = _scores(_hits(index, terms, field).join(F.broadcast(first.select("block")), "block", "left_semi"))  # SEEDS rows
    if groups is not None:
        seeds = groups.join(F.broadcast(seeds), "id").groupBy("group").agg(F.max("score").alias("score"))  # rows of SEEDS blocks
    reached = seeds.orderBy(F.desc("score")).limit(k).agg(F.when(F.count("*") == k, F.min("score")).alias("reached"))
    return bound.crossJoin(F.broadcast(reached)).filter(F.col("bound") >= F.coalesce("reached", F.lit(0.0))).select("block")  # one row


def best_rows(index: StoredIndex, terms: list[str], k: int, fields: Iterable[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(id, score): rows among which are all of the k best (or with ``groups(id, group)`` the best rows
    of the k best groups), with equal scores; rows in blocks that can't hold one are left out."""
    field = index.field(fields)
    if field is None:
        return scores(index, terms, fields)
    return _scores(_hits(index, terms, field).join(open_blocks(index, terms, k, fields, groups), "block", "left_semi"))
