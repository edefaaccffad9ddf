"""Catalog search: species results with scores, a page of specimens and the total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys
from taxaspark.operators import catalog, substring


@dataclass
class SearchResult:
    """species: (species, matched_fields, score); specimens: a page of rows with matched_fields;
    total: one row, n."""

    species: DataFrame
    specimens: DataFrame
    total: DataFrame


def _species(rows: DataFrame, flags: dict[str, Column], fallback: str, query: str, limit: int) -> DataFrame:
    groups = catalog.species_matches(rows, flags).orderBy("species_key").limit(limit)
    named = groups.select(keys.binomial_key("species").alias("species"), "species_key", exprs.matched_fields(flags, fallback).alias("matched_fields"))
    folded = named.groupBy("species").agg(F.min_by("matched_fields", "species_key").alias("matched_fields"))
    return folded.withColumn("score", exprs.relevance(F.col("species"), F.col("matched_fields"), query)).orderBy(F.desc("score"), "species")


def search_catalog(df: DataFrame, query: str, field: str = "all", page: int = 1, limit: int = 50, index: substring.SubstringIndex | None = None) -> SearchResult:
    """Search one field, all fields ("all"), or around a point ("coordinate", "lat, lon").

    A field's case and spaces don't matter, an unknown one means all. The species list is limited
    before it is scored and doesn't follow the pages. An empty query and a point that can't be read
    give empty results. With an ``index`` of the table's fields they are tested by their matching values.
    """
    query, field = query.strip(), field.strip().lower().replace(" ", "_")
    if field == "coordinate":
        hit = exprs.near_point(query)
        flags, fallback, fields = {"lat": hit, "lon": hit}, "lat", F.array(F.lit("lat"), F.lit("lon"))
    elif field in exprs.SEARCH_FIELDS and field in df.columns:
        own = substring.match_flags(index, query, [field])[field] if index else exprs.field_match(field, query)
        hit = F.coalesce(own, F.lit(False))
        flags, fallback, fields = {field: hit}, field, F.array(F.lit(field))
    else:
        names = [f for f in exprs.SEARCH_FIELDS if f in df.columns]
        flags = substring.match_flags(index, query, names) if index else catalog.match_flags(query, names)
        hit, fallback, fields = catalog.any_flag(flags), "species", exprs.fields_containing(flags, query)
    hit = hit if query else F.lit(False)
    rows = df.filter(hit)
    return SearchResult(
        species=_species(rows, flags, fallback, query, limit),
        specimens=catalog.page(rows, "img_id", page=page, limit=limit).withColumn("matched_fields", fields),
        total=rows.agg(F.count("*").alias("n")),
    )
