"""A stored copy of vectors in blocks that a search can leave out, and the exact search over it.

A few pivots are chosen; a vector belongs to its nearest one, whose folder holds its vectors in the
order of their distance to it, cut to blocks. Of each block the least and the largest distance to
every pivot are kept: by the triangle inequality no member is nearer to a query than the largest gap
between those and the query's own distances. A search measures the blocks of the least gaps first;
blocks whose gap exceeds the k-th distance found there aren't measured, and folders without a block
left aren't read. Cosine distance is half the square of the distance of unit vectors, so it has the
same bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.operators import vectors

#: Pivots, and the vectors they are chosen from: a sample of a bounded size, the first by a hash of the id.
PIVOTS, SAMPLE = 32, 2000
#: Vectors of a block; blocks that are measured to learn how near a hit must be.
BLOCK, SEEDS = 256, 8
#: What a gap allows for rounding.
SLACK = 1e-6


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return m
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size == 0, 1, size)[:, None]


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it."""
    chosen = [0] if len(sample) else []
    nearest = np.full(len(sample), np.inf)
    while chosen and len(chosen) < min(n, len(sample)):
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        if not nearest.max() > 0:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _placed(pivots: np.ndarray, column: str, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                m = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                far = np.linalg.norm(_unit(m, metric)[:, None, :] - pivots[None], axis=2)
                own = far.argmin(axis=1)
                ends = pa.array(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32))
                yield pa.record_batch([*part.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own]), pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], [*part.schema.names, "cell", "near", "far"])

    return run


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    column: str
    metric: str

    @property
    def rows(self) -> DataFrame:
        """img_id, the vector, block; in folders by cell."""
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def blocks(self) -> DataFrame:
        """cell, block, n, low and high: arrays of distances to the pivots."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def pivots(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").collect()  # PIVOTS rows
        return np.array([r["vector"] for r in found], float)


def store(df: DataFrame, path: str, column: str = "embedding", metric: str = "cosine") -> VectorIndex:
    """Write the copy of ``df(img_id, column)`` in place of what is there. Rows without a vector are
    left out; every other row is kept, whatever the pivots."""
    if metric not in vectors.METRICS:
        raise ValueError(f"metric must be one of {vectors.METRICS}")
    spark = df.sparkSession
    df = df.select("img_id", column).filter(F.col(column).isNotNull())
    sample = df.orderBy(F.xxhash64(F.col("img_id").cast("string")), "img_id").limit(SAMPLE).select(column).collect()
    pivots = choose_pivots(_unit(np.array([r[0] for r in sample], float), metric), PIVOTS) if sample else np.zeros((0, 0))
    spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "pivot int, vector array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
    fields = [*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("far", T.ArrayType(T.DoubleType()))]
    placed = df.mapInArrow(_placed(pivots, column, metric), T.StructType(fields))
    placed = placed.repartitionByRange("cell", "near", "img_id").sortWithinPartitions("cell", "near", "img_id")
    place = F.monotonically_increasing_id()  # rows of a task are numbered in their order
    cut = placed.withColumn("block", place - F.pmod(place, F.lit(BLOCK)))
    out = cut.write.mode("overwrite")
    (out.partitionBy("cell") if sample else out).parquet(f"{path}/rows")  # a folder without rows has no schema
    index = VectorIndex(spark, path, column, metric)
    least = [F.min(F.col("far")[k]) for k in range(len(pivots))]
    most = [F.max(F.col("far")[k]) for k in range(len(pivots))]
    ends = [F.array(*least).alias("low"), F.array(*most).alias("high")] if len(pivots) else [F.array().cast("array<double>").alias(c) for c in ("low", "high")]
    index.rows.groupBy("cell", "block").agg(F.count("*").alias("n"), *ends).write.mode("overwrite").parquet(f"{path}/blocks")
    return index


def gaps(index: VectorIndex, query: list[float]) -> DataFrame:
    """(cell, block, n, gap): no vector of a block has a smaller distance to the query. Zero vectors are
    at a distance of 1 by cosine; they keep to the bound, as the gap of a block with one is at most theirs."""
    q = np.array(query, float)[None]
    pivots = index.pivots()
    if not len(pivots):  # no vectors
        return index.blocks.select("cell", "block", "n", F.lit(0.0).alias("gap"))
    own = np.linalg.norm(_unit(q, index.metric) - pivots, axis=1)
    far = F.array(*[F.lit(float(x)) for x in own])
    gap = F.array_max(F.zip_with(F.zip_with("low", far, lambda low, x: low - x), F.zip_with("high", far, lambda high, x: x - high), lambda a, b: F.greatest(a, b, F.lit(0.0))))
    gap = F.greatest(gap - SLACK, F.lit(0.0))
    square = gap * gap / (2 if index.metric == "cosine" else 1)
    return index.blocks.select("cell", "block", "n", square.alias("gap"))


def search(index: VectorIndex, query: list[float], k: int = 50, max_distance: float | None = None, within: DataFrame | None = None) -> DataFrame:
    """(imgId, distance) as :func:`vectors.vector_search` finds over all rows."""
    left = open_blocks(index, query, k, max_distance, within)
    top = _measured(index, left, query, within).orderBy("distance", "imgId").limit(k).groupBy("imgId").agg(F.min("distance").alias("distance"))
    return top if max_distance is None else top.filter(F.col("distance") <= max_distance)


def _measured(index: VectorIndex, blocks: DataFrame, query: list[float], within: DataFrame | None) -> DataFrame:
    rows = index.rows.join(blocks.select("cell", "block"), ["cell", "block"], "left_semi")
    rows = rows if within is None else rows.join(within.select("img_id"), "img_id", "left_semi")
    vector = F.array(*[F.lit(float(x)) for x in query])
    distance: Column = (vectors.cosine_distance if index.metric == "cosine" else vectors.squared_l2)(F.col(index.column), vector)
    return rows.select(F.col("img_id").alias("imgId"), distance.alias("distance"))


def open_blocks(index: VectorIndex, query: list[float], k: int, max_distance: float | None = None, within: DataFrame | None = None) -> DataFrame:
    """(cell, block, n, gap) of the blocks that can hold one of the k nearest."""
    gap = gaps(index, query)
    first = gap.orderBy("gap", "cell", "block").limit(SEEDS + k // BLOCK)
    seeds = _measured(index, first, query, within).orderBy("distance", "imgId").limit(k)
    reached = seeds.agg(F.when(F.count("*") == k, F.max("distance")).alias("reached"))
    limit = F.coalesce("reached", F.lit(float("inf")))
    if max_distance is not None:
        limit = F.least(limit, F.lit(float(max_distance)))
    return gap.crossJoin(F.broadcast(reached)).filter(F.col("gap") <= limit * (1 + SLACK) + SLACK).drop("reached")  # one row
