"""Exact vector search: normalising, distances, top-k for one query and for many, centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.operators import catalog

#: Query vectors that are compared at once; items of a chunk, which a task holds in memory; chunks
#: whose best are merged at once.
QUERY_BLOCK, ITEM_CHUNK, FAN = 2000, 50_000, 32
METRICS = ("cosine", "l2")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector is left as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """From 0 to 2; 1 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 1.0).otherwise(1 - dot(a, b) / size)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def vector_search(df: DataFrame, query: list[float], column: str = "embedding", k: int = 50, max_distance: float | None = None, within: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """(imgId, distance) of the k nearest rows, one per image.

    ``within(img_id)`` restricts the rows before the search, ``max_distance`` those that were
    found, so fewer may come.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = df if within is None else df.join(within.select("img_id"), "img_id", "left_semi")
    vector = F.array(*[F.lit(float(x)) for x in query])
    distance = (cosine_distance if metric == "cosine" else squared_l2)(F.col(column), vector)
    top = rows.select(F.col("img_id").alias("imgId"), distance.alias("distance")).orderBy("distance", "imgId").limit(k)
    top = top.groupBy("imgId").agg(F.min("distance").alias("distance"))
    return top if max_distance is None else top.filter(F.col("distance") <= max_distance)


def centroid(df: DataFrame, by: list[str], column: str = "embedding", normalize: bool = False) -> DataFrame:
    """Mean vector of each group; ``normalize`` makes the vectors and the mean unit vectors.

    Sums run element by element with map-side combine, so no group is gathered in one task.
    """
    vector = l2_normalize(F.col(column)) if normalize else F.col(column)
    spread = df.select(*by, F.posexplode(vector).alias("i", "x"))
    means = spread.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    grouped = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = F.transform("v", lambda e: e["x"])
    grouped = grouped.select(*by, out.alias("centroid"))
    return grouped.withColumn("centroid", l2_normalize(F.col("centroid"))) if normalize else grouped


def side_centroids(df: DataFrame, meta: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit centroid of each species and side (dorsal, ventral); images without vectors are left out."""
    sides = meta.select("img_id", "species", F.lower("class_dv").alias("side")).filter(F.col("side").isin("dorsal", "ventral") & F.col("species").isNotNull())
    return centroid(df.select("img_id", column).join(sides, "img_id"), ["species", "side"], column, normalize=True)


def similar_to_ids(df: DataFrame, ids: DataFrame, column: str = "embedding", k: int = 50, max_distance: float | None = None) -> DataFrame:
    """Nearest rows to the mean vector of ``ids(img_id)``; the mean stays a one-row table."""
    own = df.join(ids.select("img_id").distinct(), "img_id", "left_semi")
    mean = centroid(own.withColumn("_all", F.lit(1)), ["_all"], column)
    scored = df.crossJoin(F.broadcast(mean.select("centroid")))  # one row, or none
    scored = scored.select(F.col("img_id").alias("imgId"), cosine_distance(F.col(column), F.col("centroid")).alias("distance"))
    top = scored.orderBy("distance", "imgId").limit(k).groupBy("imgId").agg(F.min("distance").alias("distance"))
    return top if max_distance is None else top.filter(F.col("distance") <= max_distance)


def best_per_species(hits: DataFrame, key: str = "species", score: str = "distance") -> DataFrame:
    """The nearest row of each species."""
    return catalog.distinct_by(hits, key, score, "imgId") if "imgId" in hits.columns else catalog.distinct_by(hits, key, score)


def search_by_vector(df: DataFrame, meta: DataFrame, query: list[float], column: str = "embedding", k: int = 50) -> DataFrame:
    return best_per_species(catalog.with_meta(vector_search(df, query, column, k), meta))


#: Items that are compared with a block of queries at once.
ITEM_BLOCK = 2000


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least distances (rounded, then by id) and their ids, in no order."""
    if distance.shape[1] <= k:
        return distance, ids
    rounded = np.round(distance, 9)
    kept = np.argpartition(rounded, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(rounded, kept, axis=1).max(axis=1)
    for row in np.flatnonzero((rounded <= edge[:, None]).sum(axis=1) > k):  # ties at the edge
        near = np.flatnonzero(rounded[row] <= edge[row])
        kept[row] = near[np.lexsort((ids[row, near], rounded[row, near]))[:k]]
    return np.take_along_axis(distance, kept, axis=1), np.take_along_axis(ids, kept, axis=1)


def _best_of_chunk(queries: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest items to each of the unit vectors ``queries``."""
    best = None
    for ids, vectors in items:
        vectors = vectors.astype(float)
        size = np.linalg.norm(vectors, axis=1)
        distance = 1 - queries @ (vectors / np.where(size == 0, 1, size)[:, None]).T
        distance[:, size == 0] = 1
        own = np.broadcast_to(ids, distance.shape)
        if best is not None:
            distance, own = np.hstack([best[0], distance]), np.hstack([best[1], own])
        best = _nearest(distance, own, k)
    return best


def _compare_chunks(k: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (chunk, side, query, img_id, item, centroid) by chunk and side: the items of a chunk are
    kept, then the queries come, a block at a time, and leave with their nearest."""

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items = None, []
        for batch in batches:
            place = batch.column("chunk").to_numpy() * 2 + batch.column("side").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for a, b in zip(bounds, bounds[1:]):
                if b == a:
                    continue
                chunk, side = divmod(int(place[a]), 2)
                if chunk != at:
                    at, items = chunk, []
                for lo in range(a, b, block if side else ITEM_BLOCK):
                    part = batch.slice(lo, min(b - lo, block if side else ITEM_BLOCK))
                    if not side:
                        items.append((part.column("img_id").to_numpy(zero_copy_only=False), matrix(part.column("item"), part.num_rows)))
                    elif items:
                        distance, ids = _best_of_chunk(matrix(part.column("centroid"), part.num_rows), items, k)
                        numbers = np.repeat(part.column("query").to_numpy(), distance.shape[1])
                        for lo_row in range(0, len(numbers), 1 << 16):
                            own = slice(lo_row, lo_row + (1 << 16))
                            n = len(numbers[own])
                            yield pa.record_batch({"query": pa.array(numbers[own]), "chunk": pa.array(np.full(n, at, np.int32)), "imgId": pa.array(ids.ravel()[own], batch.schema.field("img_id").type), "distance": pa.array(distance.ravel()[own])})

    return run


def batch_top_k(queries: DataFrame, items: DataFrame, k: int = 800, column: str = "embedding", block: int = QUERY_BLOCK, chunk: int = ITEM_CHUNK) -> DataFrame:
    """(query, imgId, distance, rank): the k nearest of ``items(img_id, column)`` to each of
    ``queries(query long, centroid)`` by cosine.

    Items are dealt to numbered chunks of about ``chunk``, which each query visits; a chunk gives k
    rows a query, and the chunks' best are merged in a tree. Neither side passes through the driver,
    and the plan doesn't grow with them. Rows without a vector are left out.
    """
    items = items.filter(F.col(column).isNotNull())
    n = items.count()
    chunks = max(1, -(-n // chunk), min(items.sparkSession.sparkContext.defaultParallelism, n // ITEM_BLOCK))
    kind, vector = dict(items.dtypes)["img_id"], dict(items.dtypes)[column]
    none = lambda t: F.lit(None).cast(t)
    own = items.select((F.monotonically_increasing_id() % chunks).cast("int").alias("chunk"), F.lit(0).alias("side"), none("long").alias("query"), "img_id", F.col(column).alias("item"), none("array<double>").alias("centroid"))
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), "query", none(kind).alias("img_id"), none(vector).alias("item"), l2_normalize(F.col("centroid")).alias("centroid"))
    met = own.unionByName(every).repartition(chunks, "chunk").sortWithinPartitions("chunk", "side")
    found = met.mapInArrow(_compare_chunks(k, block), f"query long, chunk int, imgId {kind}, distance double")
    order = (F.round("distance", 9), F.col("imgId"))
    while chunks > FAN:
        found, chunks = found.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("int")), -(-chunks // FAN)
        rank = F.row_number().over(W.partitionBy("query", "chunk").orderBy(*order))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return found.drop("chunk").withColumn("rank", rank).filter(F.col("rank") <= k)


def embed_column(df: DataFrame, column: str, encoder: Callable[[], Callable[[list], list]], dim: int, key: str = "img_id", batch: int = 150) -> DataFrame:
    """(key, embedding): unit vectors from a pluggable encoder, made once in each task.

    ``encoder()`` gives a function from a list of values to a list of vectors, or None for a value
    that it can't read; such rows are skipped, and so is a batch with a vector of a wrong size.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                made = [(i, v) for i, v in zip(part[key], encode(part[column].tolist()), strict=True) if v is not None]
                if not made or any(len(v) != dim for _, v in made):
                    continue
                unit = [(np.asarray(v, float) / (np.linalg.norm(v) or 1)).astype(np.float32).tolist() for _, v in made]
                yield pd.DataFrame({key: [i for i, _ in made], "embedding": unit})

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, embedding array<float>")
