"""A table stored in order with the number of rows of each part, so that a page is found by counting.

A part is a folder with consecutive rows, numbered within it. A page reads the parts that hold its
rows; the pages after a key are found by the parts' last keys in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART, ROW = "_part", "_row"


@dataclass
class PagedTable:
    spark: SparkSession
    path: str
    order: tuple[str, ...]

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def parts(self) -> DataFrame:
        """_part, n, start (rows before it), last (struct of the order's columns)."""
        return self.spark.read.parquet(f"{self.path}/parts")


def _key(order: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(order)])


def store(df: DataFrame, path: str, *order: str, parts: int | None = None) -> PagedTable:
    """Write ``df`` in the ascending order of columns, nulls first, in place of what is there. Rows that
    are equal in them have no stated order, but keep the one they got."""
    by = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    place = F.monotonically_increasing_id()
    numbered = dealt.sortWithinPartitions(*by).withColumn("_at", place).withColumn(PART, F.shiftright("_at", 33).cast("int")).withColumn(ROW, F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    numbered.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    try:
        df.sparkSession.read.parquet(f"{path}/rows")
    except AnalysisException:  # a folder without rows has no schema
        numbered.limit(0).write.mode("overwrite").parquet(f"{path}/rows")
    table = PagedTable(df.sparkSession, path, order)
    counted = table.rows.groupBy(PART).agg(F.count("*").alias("n"), F.max(_key(order)).alias("last"))
    start = F.sum("n").over(W.orderBy(PART)) - F.col("n")  # one row for each part
    counted.withColumn("start", start).write.mode("overwrite").parquet(f"{path}/parts")
    return table


def _read(table: PagedTable, held: DataFrame) -> DataFrame:
    """Rows of the parts of ``held(_part, start)``, a page's, with their number in the table."""
    starts = {r[PART]: r["start"] for r in held.collect()}
    if not starts:
        return table.rows.filter(F.lit(False)).withColumn("_number", F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for part, at in starts.items() for x in (part, at)])
    folder = f"{table.path}/rows"
    own = table.spark.read.option("basePath", folder).parquet(*[f"{folder}/{PART}={part}" for part in starts])
    return own.withColumn("_number", start[F.col(PART)] + F.col(ROW))


def _page(rows: DataFrame, first: Column | int, limit: int) -> DataFrame:
    own = rows.filter((F.col("_number") >= first) & (F.col("_number") < first + limit))
    return own.orderBy("_number").drop("_number", PART, ROW)


def page(table: PagedTable, page: int = 1, limit: int = 50) -> DataFrame:
    """One page; pages count from 1. Only the parts that hold it are read."""
    first = (max(1, page) - 1) * limit
    held = table.parts.filter((F.col("start") < first + limit) & (F.col("start") + F.col("n") > first))
    return _page(_read(table, held), first, limit)


def page_after(table: PagedTable, key: tuple, limit: int = 50) -> DataFrame:
    """The rows that follow a key, which need not be in the table."""
    if len(key) != len(table.order):
        raise ValueError(f"the order has {len(table.order)} columns")
    types = dict(table.rows.select(*[F.col(f"`{c}`") for c in table.order]).dtypes)
    own = F.struct(*[F.lit(x).cast(types[c]).alias(f"k{n}") for n, (c, x) in enumerate(zip(table.order, key))])
    at = table.parts.filter(F.col("last") > own).agg(F.min(PART).alias("p")).first()["p"]  # the part that holds the next row
    if at is None:
        return _read(table, table.parts.limit(0)).drop("_number", PART, ROW)
    before = table.rows.filter((F.col(PART) == at) & (_key(table.order) <= own)).count()
    first = table.parts.filter(F.col(PART) == at).first()["start"] + before
    held = table.parts.filter((F.col("start") < first + limit) & (F.col("start") + F.col("n") > first))
    return _page(_read(table, held), first, limit)
