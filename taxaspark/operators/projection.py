"""2-D projections: cluster samples, tiles of a map pyramid, and projecting vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A tile's and an image's side in pixels, and the margin left around an image.
TILE, IMAGE, MARGIN = 256, 128, 4
#: What a plot adds to each end of an axis, and a map's centre without points.
PLOT_PAD, MAP_CENTRE = 0.6, (20.0, 0.0)


def cluster_sample(projection: DataFrame, meta: DataFrame, species: str | None = None, n: int = 5) -> DataFrame:
    """Up to n rows of each species and cluster, those with coordinates first: (img_id, x, y,
    cluster_label, lat, lon)."""
    own = meta.select("img_id", F.col("species").alias("_species"), "lat", "lon")
    rows = projection.join(own, "img_id")
    if species is not None:
        rows = rows.filter(F.col("_species") == species)
    located = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 1).otherwise(0)
    rank = F.row_number().over(W.partitionBy("_species", "cluster_label").orderBy(F.desc(located), "img_id"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).select("img_id", F.col("UMAP1").alias("x"), F.col("UMAP2").alias("y"), "cluster_label", "lat", "lon")


def cluster_count(sample: DataFrame) -> DataFrame:
    """Distinct clusters of a sample; null is one of them."""
    return sample.select("cluster_label").distinct().agg(F.count("*").alias("n_clusters"))


def normalize_xy(df: DataFrame, pad: float = 0.05) -> DataFrame:
    """x and y scaled to [pad, 1 - pad]; an axis without extent is divided by 1."""
    ends = df.agg(*[f(c).alias(f"_{c}_{n}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str) -> Column:
        span = F.col(f"_{c}_high") - F.col(f"_{c}_low")
        return pad + (1 - 2 * pad) * (F.col(c) - F.col(f"_{c}_low")) / F.when(span == 0, 1.0).otherwise(span)

    return df.crossJoin(F.broadcast(ends)).withColumns({"x": scaled("x"), "y": scaled("y")}).select(*df.columns)


def tile_index(points: DataFrame, max_zoom: int = 9) -> DataFrame:
    """``points(id, x, y)`` on [0, 1] to (id, x, y, z, tx, ty): every tile that a point's image, with
    its margin, touches at each zoom. At most 2 x 2 tiles a zoom beyond the first."""
    m = (IMAGE / 2 + MARGIN) / TILE
    at = points.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom)))).withColumn("_n", F.expr("shiftleft(1L, z)"))

    def tiles(c: str) -> Column:
        low = F.floor(F.col(c) * F.col("_n") - 1 - m) + 1
        high = F.floor(F.col(c) * F.col("_n") + m)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("_n") - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return at.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y"))).drop("_n")


def tile_layout(tiles: DataFrame, density: int = 1) -> DataFrame:
    """Adds a point's place in its tile, in pixels, and the corner at which its image is pasted."""
    n = F.expr("shiftleft(1L, z)")
    px = (F.col("x") * n - F.col("tx")) * TILE * density
    py = (F.col("y") * n - F.col("ty")) * TILE * density
    half = IMAGE * density / 2
    return tiles.withColumns({"px": px, "py": py, "paste_x": (px - half).cast("int"), "paste_y": (py - half).cast("int")})


def tile_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z", "tx", "ty").agg(F.count("*").alias("n_points"))


def zoom_counts(tiles: DataFrame) -> DataFrame:
    return tile_counts(tiles).groupBy("z").agg(F.count("*").alias("n_tiles"), F.sum("n_points").alias("n_points"))


#: Parts of a tile's side that a cell is; the margin is a whole number of them.
CELL = 64


def pyramid_counts(points: DataFrame, max_zoom: int = 9) -> DataFrame:
    """(z, tx, ty, n_points) as :func:`tile_counts` of :func:`tile_index`, without a row for each point
    and tile.

    Points are counted once, by the cells of the deepest zoom; a cell's number halves from zoom to
    zoom. What is shuffled after that is bounded by the cells: of each zoom its cells, and of each
    cell the at most two tiles on an axis whose margins reach it.
    """
    deep, reach = CELL << max_zoom, (IMAGE // 2 + MARGIN) * CELL // TILE
    at = [F.floor(F.col(c) * deep).cast("long").alias(f"c{c}") for c in ("x", "y")]
    cells = points.select(*at).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    zooms = cells.select(F.explode(F.sequence(F.lit(0), F.lit(max_zoom))).alias("z"), "cx", "cy", "n")
    up = lambda c: F.expr(f"shiftright({c}, {max_zoom} - z)").alias(c)
    rolled = zooms.select("z", up("cx"), up("cy"), "n").groupBy("z", "cx", "cy").agg(F.sum("n").alias("n"))

    def tiles(c: str) -> Column:
        last = F.expr("shiftleft(1L, z)") - 1
        low = F.greatest(F.lit(0), F.floor((F.col(c) - reach) / CELL))  # the tile before, if its margin reaches the cell
        high = F.least(last, F.floor((F.col(c) + reach) / CELL))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    spread = rolled.withColumn("tx", F.explode(tiles("cx"))).withColumn("ty", F.explode(tiles("cy")))
    return spread.groupBy("z", "tx", "ty").agg(F.sum("n").alias("n_points"))


def project_2d(df: DataFrame, column: str = "embedding", key: str = "img_id") -> DataFrame:
    """(key, x, y): the first two principal components, fitted by Spark over all rows. An axis points the
    way in which the largest of its weights is positive. Rows are projected as they are, not centred."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    signs = [1.0 if max(axis, key=abs) > 0 else -1.0 for axis in model.pc.toArray().T.tolist()]  # as many weights as a vector is long
    out = model.transform(rows).select(key, vector_to_array("p").alias("p"))
    return out.select(key, *[(F.get("p", F.lit(k)) * s).alias(c) for k, (c, s) in enumerate(zip("xy", signs, strict=True))])


def plot_bounds(df: DataFrame) -> DataFrame:
    return df.agg(*[(f(c) + d).alias(f"{c}_{n}") for c in ("x", "y") for n, f, d in (("low", F.min, -PLOT_PAD), ("high", F.max, PLOT_PAD))])


def map_center(df: DataFrame, order: str = "img_id") -> DataFrame:
    """(lat, lon) of the first point that has both, else the default."""
    first = df.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").agg(F.min_by(F.struct("lat", "lon"), order).alias("p"))
    return first.select(*[F.coalesce(F.col(f"p.{c}"), F.lit(v)).alias(c) for c, v in zip(("lat", "lon"), MAP_CENTRE, strict=True)])
