"""Score fusion of ranking and filtering tools.

A tool gives rows (imgId, species, score). Ranking tools score, filtering tools gate: only species that
every filtering tool returned pass, among those that a ranking tool found. A filter without rows closes
the gate; a tool that failed is left out by the caller with ``failed=True``. Where a tool ranks, filter
rows carry no score and are no hits, but a filter with rows counts among the tools whose miss costs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.functions import exprs
from taxaspark.operators import catalog, vectors

#: What each tool that misses costs, and the rows returned.
PENALTY, TOP = 0.15, 50
RANKING_LIMIT, FILTER_LIMIT, IMAGE_LIMIT = 500, 1000, 300


@dataclass
class Tool:
    """A call's name, kind ("ranking" or "filter") and rows (imgId, species, score)."""

    name: str
    kind: str
    rows: DataFrame | None = None
    failed: bool = False


def min_max_score(df: DataFrame, weight: float = 1.0, distance: str = "distance") -> DataFrame:
    """score: the weight for the nearest row down to 0 for the farthest; the weight if all are alike.

    Lowest and highest are a one-row aggregate, so no window gathers the rows.
    """
    ends = df.agg(F.min(distance).alias("_low"), F.max(distance).alias("_high"))
    span = F.col("_high") - F.col("_low")
    score = F.when(span > 0, weight * (1 - (F.col(distance) - F.col("_low")) / span)).otherwise(F.lit(weight))
    return df.crossJoin(F.broadcast(ends)).withColumn("score", score).drop("_low", "_high")


def search_by_location(occurrences: DataFrame, meta: DataFrame, place: str, limit: int = FILTER_LIMIT, within: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """All images of up to ``limit`` species that occur at a place."""
    rows = occurrences.filter(exprs.location_filter(place))
    rows = rows if within is None else catalog.within_species(rows, within)
    names = catalog.drop_blank(rows, "species").select("species").distinct().orderBy("species").limit(limit)
    return catalog.images_for_species(meta, names).withColumn("score", F.lit(weight))


def search_by_traits(traits: DataFrame, meta: DataFrame, limit: int = FILTER_LIMIT, within: DataFrame | None = None, weight: float = 1.0, **affinities: str) -> DataFrame:
    rows = traits.filter(exprs.trait_filter(**affinities))
    rows = rows if within is None else catalog.within_species(rows, within)
    names = catalog.drop_blank(rows, "species").select("species").distinct().orderBy("species").limit(limit)
    return catalog.images_for_species(meta, names).withColumn("score", F.lit(weight))


def search_by_text_vector(items: DataFrame, meta: DataFrame, query: list[float], limit: int = RANKING_LIMIT, column: str = "embedding", weight: float = 1.0) -> DataFrame:
    """Best image of each species near a text's vector."""
    best = vectors.search_by_vector(items, meta, query, column, max(10 * limit, IMAGE_LIMIT))
    best = best.orderBy("distance", "imgId").limit(limit)
    return min_max_score(best, weight).select("imgId", "species", "score")


def search_by_image_similarity(items: DataFrame, meta: DataFrame, name: str, limit: int = RANKING_LIMIT, column: str = "embedding", weight: float = 1.0) -> DataFrame:
    """Images near those of a species; the species itself stays."""
    hits = vectors.similar_to_ids(items, catalog.image_ids(meta, name), column, limit)
    return min_max_score(vectors.best_per_species(catalog.with_meta(hits, meta)), weight).select("imgId", "species", "score")


def tool_weights(tools: list[Tool]) -> dict[str, float]:
    """Equal shares of the ranking tools, or of the filters where nothing ranks."""
    ranking = {t.name for t in tools if t.kind == "ranking"}
    filters = {t.name for t in tools if t.kind == "filter"}
    share = 1 / len(ranking or filters) if ranking or filters else 0.0
    return {n: share for n in (ranking or filters)} | ({n: 0.0 for n in filters} if ranking else {})


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


def gate(filters: list[Tool]) -> DataFrame | None:
    """Species that each working filtering tool returned; None if there is no filter at all."""
    rows = [t.rows.select("species").distinct().withColumn("tool", F.lit(k)) for k, t in enumerate(filters) if not t.failed]
    if not rows:
        return None
    return _union(rows).groupBy("species").agg(F.countDistinct("tool").alias("n")).filter(F.col("n") == len(rows)).select("species")


def _with_rows(tools: list[Tool], scope: DataFrame | None) -> DataFrame:
    """One row: how many differently named tools gave a row (within ``scope`` where they filter)."""
    kept = [t.rows if scope is None or t.kind == "ranking" else t.rows.join(scope, "species", "left_semi") for t in tools]
    return _union([rows.limit(1).select(F.lit(t.name).alias("tool")) for t, rows in zip(tools, kept, strict=True)]).agg(F.countDistinct("tool").alias("active"))


def fused_search(tools: list[Tool], hits: str = "rows", top: int = TOP) -> DataFrame | None:
    """(species, imgId, score, tool_names), best first; None if no tool is left to give rows.

    ``hits="rows"`` sums the scores of all rows of a species; "binary" takes one row of each species
    and tool. A tool called twice is one tool, and all its rows are summed.
    """
    weights = tool_weights(tools)
    ranks = any(t.kind == "ranking" for t in tools)
    working = [t for t in tools if not t.failed]
    filters = [t for t in working if t.kind == "filter"]
    used = [t for t in working if t.kind == "ranking"] if ranks else filters
    if not used or (not filters and any(t.kind == "filter" for t in tools)):
        return None
    rows = _union([t.rows.select("imgId", "species", (F.col("score") * weights[t.name]).alias("score"), F.lit(t.name).alias("tool")) for t in used])
    scope = rows.select("species").distinct() if ranks else None
    passed = gate(filters)
    if passed is not None:
        rows = rows.join(passed, "species", "left_semi")
    if hits == "binary":
        rows = rows.groupBy("species", "tool").agg(F.min(F.struct((-F.col("score")).alias("down"), "imgId")).alias("r")).select("species", "tool", (-F.col("r.down")).alias("score"), "r.imgId")
    first: Column = F.struct(-F.col("score"), "tool", "imgId")
    fused = rows.groupBy("species").agg(F.sum("score").alias("total"), F.sort_array(F.collect_set("tool")).alias("tool_names"), F.min_by("imgId", first).alias("imgId"))
    fused = fused.crossJoin(F.broadcast(_with_rows(working, scope)))  # one row
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") - PENALTY * (F.col("active") - F.size("tool_names"))))
    return fused.select("species", "imgId", exprs.rounded_score(score).alias("score"), "tool_names").orderBy(F.desc("score"), "species").limit(top)


def per_species_rank(df: DataFrame, score: str = "score", n: int = 1) -> DataFrame:
    """The n best rows of each species."""
    rank = F.row_number().over(W.partitionBy("species").orderBy(F.desc(score), "imgId"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)
