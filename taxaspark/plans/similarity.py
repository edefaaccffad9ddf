"""Similar species: at run time for one, as a stored table for all, and the lookup of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.functions import keys
from taxaspark.operators import catalog, vectors

SIDES = ("dorsal", "ventral")
#: Neighbours of a centroid before images are folded to species, and species kept of a side.
NEIGHBOURS, KEPT = 800, 10


def similar_species(meta: DataFrame, items: DataFrame, name: str, limit: int = KEPT, column: str = "embedding") -> DataFrame:
    """(side, species, imgId, distance): species near the centroid of ``name``'s images of a side.

    The limit holds before images are folded to species and the species itself goes, so fewer rows
    are usual.
    """
    own, out = catalog.image_meta_by_species(meta, name), None
    for side in SIDES:
        hits = vectors.similar_to_ids(items, catalog.side_filter(own, side), column, limit)
        best = vectors.best_per_species(catalog.with_meta(hits, meta))
        part = catalog.exclude_species(best, name).select(F.lit(side).alias("side"), "species", "imgId", "distance")
        out = part if out is None else out.unionByName(part)
    return out


def build_similarity(items: DataFrame, meta: DataFrame, k: int = NEIGHBOURS, limit: int = KEPT, species: DataFrame | None = None, column: str = "embedding") -> DataFrame:
    """(species, side, similar_species, img_id, distance, rank) for every species and side, or for
    those in ``species(species)``. Neighbours are taken from both sides."""
    own = meta if species is None else catalog.within_species(meta, species)
    number = F.xxhash64("species", "side")
    queries = vectors.side_centroids(items, own, column).withColumn("query", number)
    near = vectors.batch_top_k(queries, items, k, column)
    named = near.join(queries.select("query", "species", "side"), "query").join(catalog.unique_meta(meta).select(F.col("img_id").alias("imgId"), F.col("species").alias("similar_species")), "imgId")
    named = named.filter(F.col("similar_species").isNotNull() & (keys.underscore_key("similar_species") != keys.underscore_key("species")))
    best = named.groupBy("species", "side", "similar_species").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "imgId")).alias("b"))
    rank = F.row_number().over(W.partitionBy("species", "side").orderBy("b.distance", "b.imgId", "similar_species"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return ranked.select("species", "side", "similar_species", F.col("b.imgId").alias("img_id"), F.col("b.distance").alias("distance"), "rank")


def similar_lookup(table: DataFrame, name: str, limit: int = KEPT) -> DataFrame:
    """One row with the arrays dorsal and ventral of (species, imgId, distance), by rank; no row if
    both are empty."""
    own = table.filter((keys.underscore_key("species") == keys.underscore_key(F.trim(F.lit(name)))) & (F.col("rank") <= limit))
    entry = F.struct("rank", F.col("similar_species").alias("species"), F.col("img_id").alias("imgId"), "distance")
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, entry))), lambda e: e.dropFields("rank")).alias(s) for s in SIDES]
    return own.agg(*lists).filter(" or ".join(f"size({s}) > 0" for s in SIDES))


def similar_many(table: DataFrame, meta: DataFrame, items: DataFrame, names: DataFrame, **options) -> DataFrame:
    """Rows of the table for the species of ``names(species)`` that it has, computed ones for the rest."""
    asked = names.select("species", keys.underscore_key("species").alias("_key")).dropDuplicates(["_key"])
    stored = table.withColumn("_key", keys.underscore_key("species"))
    found = stored.join(asked.select("_key"), "_key", "left_semi").drop("_key")
    missing = asked.join(stored.select("_key"), "_key", "left_anti").select("species")
    return found.unionByName(build_similarity(items, meta, species=missing, **options))


def verify_similarity(table: DataFrame) -> DataFrame:
    """(side, n, n_species) of each side and, with side null, of the table."""
    return table.rollup("side").agg(F.count("*").alias("n"), F.countDistinct("species").alias("n_species"))
