"""Lookups, joins, groups and paging over the specimen catalog.

A catalog has a row per specimen image: img_id, species, family, sex, class_dv (side), lat, lon,
source_db and the ranks above. All functions are lazy and return DataFrames; where one row or a
bounded list is asked for, img_id breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys

#: Columns that may be shown, and images looked at per species.
PUBLIC = ("license", "uuid", "uri", "class_dv", "lat", "lon", "source_db")
IMAGES_PER_SPECIES = 100
SOURCES = ("gbif", "ecdysis", "scanbugs")


def page(df: DataFrame, *order: str | Column, page: int = 1, limit: int = 50) -> DataFrame:
    """One page of ``df`` in a total order; pages count from 1."""
    return df.orderBy(*order).offset((max(1, page) - 1) * limit).limit(limit)


def of_species(df: DataFrame, name: str) -> DataFrame:
    """Rows whose stored name, squeezed, equals the squeezed query."""
    return df.filter(keys.squeezed_key("species") == keys.squeezed_query(F.lit(name)))


def image_ids(df: DataFrame, name: str, limit: int = IMAGES_PER_SPECIES) -> DataFrame:
    return of_species(df, name).select("img_id").orderBy("img_id").limit(limit)


def image_meta_by_species(df: DataFrame, name: str, limit: int = IMAGES_PER_SPECIES) -> DataFrame:
    return of_species(df, name).select("img_id", "species", "source_db", "class_dv").orderBy("img_id").limit(limit)


def main_image(df: DataFrame, name: str) -> DataFrame:
    return of_species(df, name).agg(F.min("img_id").alias("img_id")).filter("img_id is not null")


def image_count(df: DataFrame, name: str) -> DataFrame:
    return of_species(df, name).agg(F.count("*").alias("n_images"))


def meta_by_id(df: DataFrame, image: str, key: str = "img_id") -> DataFrame:
    """The row of one image; a file ending is taken off the id."""
    return df.filter(F.col(key).cast("string") == image.removesuffix(".png")).orderBy(*df.columns).limit(1)


def public_meta(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PUBLIC if c in df.columns])


def image_path(vectors: DataFrame, image: str) -> DataFrame:
    return vectors.filter(F.col("img_id").cast("string") == image).select("img_path").orderBy("img_path").limit(1)


def species_image_path(df: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    return vectors.join(main_image(df, name), "img_id").select("img_id", "img_path")


def images_exist(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(img_id)`` that have a row."""
    return ids.join(df.select("img_id"), "img_id", "left_semi")


def first_record(df: DataFrame, name: str, column: str = "species") -> DataFrame:
    """First row whose name is equal but for case."""
    return df.filter(keys.lower_key(column) == name.lower()).orderBy(*df.columns).limit(1)


def side_filter(df: DataFrame, side: str) -> DataFrame:
    return df.filter(F.lower("class_dv") == side.lower())


def exclude_species(df: DataFrame, name: str) -> DataFrame:
    return df.filter(keys.underscore_key("species") != keys.underscore_key(F.lit(name)))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.trim(column)).filter(exprs.not_blank(F.col(column)))


def valid_coords(df: DataFrame) -> DataFrame:
    """Rows with both coordinates; class "Unknown" and cluster -1 where they are null."""
    df = df.filter(exprs.has_coordinates())
    filled = {"class_dv": F.lit("Unknown"), "cluster_label": F.lit(-1)}
    return df.withColumns({c: F.coalesce(c, v) for c, v in filled.items() if c in df.columns})


def with_meta(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Vector hits with species, source and side; images with several rows multiply."""
    return hits.join(meta.select(F.col("img_id").alias("imgId"), "species", "source_db", "class_dv"), "imgId")


def images_for_species(meta: DataFrame, names: DataFrame) -> DataFrame:
    """(imgId, species) of every image of ``names(species)``; names that repeat multiply."""
    wanted = names.select(keys.underscore_key("species").alias("key"))
    own = meta.select(F.col("img_id").alias("imgId"), "species", keys.underscore_key("species").alias("key"))
    return own.join(wanted, "key").select("imgId", "species")


def image_ids_for_species(meta: DataFrame, names: DataFrame) -> DataFrame:
    return images_for_species(meta, names).select("imgId")


def meta_by_ids(meta: DataFrame, ids: DataFrame, key: str = "img_id") -> DataFrame:
    return meta.join(ids.select(F.col("img_id").alias(key)), key)


def existing_species(meta: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct keys of ``names(species)`` that the catalog has."""
    own = meta.select(keys.underscore_key("species").alias("species_key"))
    return names.select(keys.underscore_key("species").alias("species_key")).distinct().join(own, "species_key", "left_semi")


def within_species(df: DataFrame, names: DataFrame, column: str = "species") -> DataFrame:
    """Rows of the species in ``names(species)``."""
    scope = names.select(keys.underscore_key("species").alias("_key")).distinct()
    return df.join(scope, keys.underscore_key(column) == F.col("_key"), "left_semi")


def unique_meta(meta: DataFrame) -> DataFrame:
    """One row per image: of repeats the one of the last species by name."""
    return meta.groupBy("img_id").agg(F.max("species").alias("species"))


def species_matches(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Groups by name key with a name, whether any row of the group has each flag, and n, their rows."""
    made = [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"hit_{f}") for f, c in flags.items()]
    return df.groupBy(keys.underscore_key("species").alias("species_key")).agg(F.min("species").alias("species"), *made, F.count("*").alias("n"))


def match_flags(query: str, fields: Iterable[str] = exprs.SEARCH_FIELDS) -> dict[str, Column]:
    return {f: exprs.field_match(f, query) for f in fields}


def any_flag(flags: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in flags.values()])


def source_counts(df: DataFrame, canonical: Iterable[str] = SOURCES) -> DataFrame:
    """Rows by source; any other source, null too, counts as "other"."""
    source = F.when(F.col("source_db").isin(*canonical), F.col("source_db")).otherwise("other")
    return df.groupBy(source.alias("source")).agg(F.count("*").alias("n"))


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("family").agg(F.count("*").alias("n"))


def top_species(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy("species").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species").limit(n)


def count_unique_species(df: DataFrame) -> DataFrame:
    return df.agg(F.nullif(F.countDistinct("species"), F.lit(0)).alias("n_species"))


def collection_stats(meta: DataFrame, occurrences: DataFrame | None = None, traits: DataFrame | None = None) -> DataFrame:
    """Counts over a collection, as one row; tables that aren't given count 0."""
    own = meta.agg(F.count("*").alias("n_specimens"), F.countDistinct("family").alias("n_families"), F.countDistinct("species").alias("n_species"))
    for name, df in (("n_occurrence_species", occurrences), ("n_trait_species", traits)):
        own = own.withColumn(name, F.lit(0).cast("long")) if df is None else own.crossJoin(df.agg(F.countDistinct("species").alias(name)))
    return own


def with_share(df: DataFrame, value: str = "n") -> DataFrame:
    """Adds the percentage of the total, one decimal. For the few rows of a chart."""
    total = F.sum(value).over(W.partitionBy())
    return df.withColumn("share", F.when(total > 0, F.round(100 * F.col(value) / total, 1)).otherwise(0.0))


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def with_representative(df: DataFrame, order: str = "img_id") -> DataFrame:
    """Marks the first row of each cluster; a null cluster counts as -1. The firsts are an aggregate
    of one row a cluster, so no cluster is gathered."""
    rows = df.withColumn("cluster_label", F.coalesce("cluster_label", F.lit(-1)))
    firsts = rows.groupBy("cluster_label").agg(F.min(order).alias("_first"))
    return rows.join(firsts, "cluster_label").withColumn("is_representative", F.col(order) == F.col("_first")).select(*df.columns, "is_representative")


def distinct_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    kept = df.groupBy(key).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in (key, *order)])).alias("r"))
    return kept.select(*[F.col(c) if c == key else F.col(f"r.`{c}`") for c in df.columns])
