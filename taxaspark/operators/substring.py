"""A stored index for substring search: the distinct values of each field, and their three-letter pieces.

A query is answered from the values, which are far fewer than the rows: those that hold all of its
pieces are intersected and then tested by the same predicate as a scan would. The rows are read
with the values that matched; a field that none of its values matches isn't read at all.

Below the index's path: ``values`` (field, value, n) by field and value, ``pieces`` (piece, field, value)
by piece.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.functions import exprs

#: Letters of a piece; values of a field that a query is rewritten to, beyond which the field is scanned.
SIZE, FEW = 3, 1000


@dataclass
class SubstringIndex:
    spark: SparkSession
    path: str

    @property
    def values(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/values")

    @property
    def pieces(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pieces")


def _pieces(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.char_length(text) - SIZE + 1)
    return F.when(F.char_length(text) >= SIZE, F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(SIZE)))))


def store(df: DataFrame, path: str, fields: Iterable[str] = exprs.SEARCH_FIELDS) -> SubstringIndex:
    """Write the index of the fields that ``df`` has, in place of what is there. Nulls match nothing."""
    own = [f for f in fields if f in df.columns]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in own])).alias("c")).select("c.*")
    values = cells.filter("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    values.repartitionByRange("field", "value").sortWithinPartitions("field", "value").write.mode("overwrite").parquet(f"{path}/values")
    index = SubstringIndex(df.sparkSession, path)
    spread = index.values.select("field", "value", F.explode(_pieces(F.lower(exprs.spaced("value")))).alias("piece"))
    order = ["piece", "field", "value"]
    spread.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/pieces")
    return index


def query_pieces(spark: SparkSession, query: str) -> list[str]:
    """Pieces that every match of a query holds: of what lies between its wildcards."""
    parts = [p for p in query.replace("_", " ").split("%") if p]
    if not query.isascii():  # letters as Spark folds them
        parts = spark.range(1).select(*[F.lower(F.lit(p)).alias(f"p{k}") for k, p in enumerate(parts)]).first() or []
    folded = [p.lower() if p.isascii() else p for p in parts]
    return sorted({p[k : k + SIZE] for p in folded for k in range(len(p) - SIZE + 1)})


def matching(index: SubstringIndex, query: str, fields: Iterable[str] | None = None) -> DataFrame:
    """(field, value, n): the values that :func:`exprs.field_match` finds, and their numbers of rows.
    A query without a whole piece is tested on all values."""
    chosen = F.col("field").isin(*fields) if fields is not None else F.lit(True)
    values, pieces = index.values.filter(chosen), query_pieces(index.spark, query)
    if pieces:
        held = index.pieces.filter(chosen & F.col("piece").isin(*pieces)).groupBy("field", "value").agg(F.count("*").alias("held"))
        values = values.join(held.filter(F.col("held") == len(pieces)).select("field", "value"), ["field", "value"], "left_semi")
    return values.filter(exprs.field_match("value", query))


def match_count(index: SubstringIndex, query: str, field: str) -> DataFrame:
    """Number of rows whose field matches, as one row, without reading them."""
    return matching(index, query, [field]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def match_flags(index: SubstringIndex, query: str, fields: Iterable[str]) -> dict[str, Column]:
    """For each field whether it matches, as a test on its values. A field with more than ``FEW``
    matching values is tested as by a scan, with the same result."""
    fields = list(fields)
    number = F.row_number().over(W.partitionBy("field").orderBy("value"))
    found = matching(index, query, fields).select("field", "value", number.alias("k")).filter(F.col("k") <= FEW + 1).collect()
    out = {}
    for f in fields:
        own = [r["value"] for r in found if r["field"] == f]
        out[f] = exprs.field_match(f, query) if len(own) > FEW else F.col(f"`{f}`").isin(*own) if own else F.lit(False)
    return out
