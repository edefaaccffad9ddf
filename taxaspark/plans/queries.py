"""The registered queries of the library's own operators, with SQL for an independent engine.

Every query reads the given tables whole, by way of the views in ``fixtures``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys
from taxaspark.operators import catalog, corpora, fulltext, paged, projection, spatial, statistics, substring, taxonomy, vectorindex, vectors
from taxaspark.plans import fixtures as fx
from taxaspark.plans import fusion, search, similarity
from taxaspark.plans.fixtures import sql
from taxaspark.plans.registry import query
from taxaspark.sources import stored

KEY = "lower(replace(species, ' ', '_'))"
_UP = "(50000 / 111100::DOUBLE)"
_SIDE = f"({_UP} / greatest(cos(radians(-10.0::DOUBLE)), 0.01))"


@query(sql(f"SELECT {KEY} AS species_key, min(species) AS species, bool_or(replace(family, '_', ' ') ILIKE '%ECON%') AS hit_family, count(*) AS n FROM catalog WHERE replace(family, '_', ' ') ILIKE '%ECON%' GROUP BY 1", "catalog"))
def catalog_field(spark, d):
    hit = exprs.field_match("family", "ECON")
    return catalog.species_matches(fx.catalog(spark, d).filter(hit), {"family": hit})


_ALL = " OR ".join(f"coalesce(replace({c}, '_', ' ') ILIKE '%male%', false)" for c in ("class_dv", "family", "species", "sex", "life_stage", "source_db", "kingdom", "phylum", "class", '"order"', "common_name"))


@query(sql(f"SELECT count(*) AS n FROM {fx.FLAT} WHERE {_ALL}", "catalog"))
def catalog_all_total(spark, d):
    return search.search_catalog(fx.catalog(spark, d), "male").total


@query(sql(f"SELECT img_id, species, sex, ['sex'] AS matched_fields FROM {fx.FLAT} WHERE {_ALL} ORDER BY img_id LIMIT 50 OFFSET 50", "catalog"))
def catalog_all_page(spark, d):
    return search.search_catalog(fx.catalog(spark, d), "male", page=2).specimens.select("img_id", "species", "sex", "matched_fields")


@query(sql(f"SELECT k AS species, CASE WHEN k LIKE 'blue%' THEN 0.95 ELSE 0.9 END::DOUBLE AS score, ['species'] AS matched_fields FROM (SELECT DISTINCT {KEY} AS k FROM catalog WHERE replace(species, '_', ' ') ILIKE '%blue%' ORDER BY 1 LIMIT 50)", "catalog"))
def catalog_species_scores(spark, d):
    return search.search_catalog(fx.catalog(spark, d), "blue", "species").species.select("species", "score", "matched_fields")


@query(sql(f"SELECT img_id, lat, lon, ['lat','lon'] AS matched_fields FROM catalog WHERE lat BETWEEN -10.0 - {_UP} AND -10.0 + {_UP} AND lon BETWEEN -161.0 - {_SIDE} AND -161.0 + {_SIDE} ORDER BY img_id LIMIT 50", "catalog"))
def catalog_box(spark, d):
    return search.search_catalog(fx.catalog(spark, d), "-10.0, -161.0", "coordinate").specimens.select("img_id", "lat", "lon", "matched_fields")


def substring_index(spark, d):
    """The stored index of the catalog's fields; made by the first query that needs it."""
    return substring.SubstringIndex(spark, stored.once(spark, "substring-index", fx.sources(d), lambda to: substring.store(fx.catalog(spark, d), to)))


@query(sql(f"SELECT img_id, species, sex, ['sex'] AS matched_fields FROM {fx.FLAT} WHERE {_ALL} ORDER BY img_id LIMIT 50 OFFSET 50", "catalog"))
def catalog_all_page_by_index(spark, d):
    return search.search_catalog(fx.catalog(spark, d), "male", page=2, index=substring_index(spark, d)).specimens.select("img_id", "species", "sex", "matched_fields")


@query(sql(f"SELECT count(*) AS n FROM {fx.FLAT} WHERE replace(species, '_', ' ') ILIKE '%lue%t%'", "catalog"))
def catalog_total_by_index(spark, d):
    return substring.match_count(substring_index(spark, d), "lue%t", "species")


@query(sql("SELECT 'common_name' AS field, common_name AS value, count(*) AS n FROM catalog WHERE common_name ILIKE '%000%' GROUP BY 2 UNION ALL SELECT 'species', species, count(*) FROM catalog WHERE species ILIKE '%000%' GROUP BY 2", "catalog"))
def catalog_values(spark, d):
    return substring.matching(substring_index(spark, d), "000", ["common_name", "species"])


def placed_catalog(spark, d):
    """The catalog in the order of its places."""
    return spark.read.parquet(stored.once(spark, "catalog-by-place", fx.sources(d), lambda to: spatial.store(fx.catalog(spark, d), to)))


@query(sql("SELECT img_id, lat, lon FROM catalog WHERE lat BETWEEN -20.5 AND 33 AND lon BETWEEN -70 AND 10.25", "catalog"))
def catalog_box_by_key(spark, d):
    return placed_catalog(spark, d).filter(spatial.in_box(-20.5, 33, -70, 10.25)).select("img_id", "lat", "lon")


def paged_catalog(spark, d):
    """The catalog in the order of its species, with the counts of its parts."""
    path = stored.once(spark, "catalog-pages", fx.sources(d), lambda to: paged.store(fx.catalog(spark, d), to, "species", "img_id"))
    return paged.PagedTable(spark, path, ("species", "img_id"))


@query(sql("SELECT species, img_id, family FROM catalog ORDER BY species, img_id LIMIT 40 OFFSET 920", "catalog"))
def catalog_page_by_counts(spark, d):
    return paged.page(paged_catalog(spark, d), 24, 40).select("species", "img_id", "family")


@query(sql(f"SELECT species, img_id FROM {fx.FLAT} WHERE (species, img_id) > ('large plate', 300) ORDER BY species, img_id LIMIT 75", "catalog"))
def catalog_page_after_key(spark, d):
    return paged.page_after(paged_catalog(spark, d), ("large plate", 300), 75).select("species", "img_id")


def collection_states(spark, d):
    """States of the catalog's parts: here the specimens of each source."""
    def make(path):
        own = statistics.Statistics(spark, path, ("family", "species", "common_name"))
        rows = fx.catalog(spark, d).select("source_db", *own.fields)
        rows.write.mode("overwrite").parquet(f"{path}/rows")  # else each part makes the whole catalog anew
        rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        own.refresh((s or "none", rows.filter(F.col("source_db").eqNullSafe(F.lit(s)))) for s in ("gbif", "ecdysis", "scanbugs", "inat", None))

    return statistics.Statistics(spark, stored.once(spark, "collection-states", fx.sources(d), make), ("family", "species", "common_name"))


_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM catalog{{0}}" for c in ("family", "species", "common_name"))


@query(sql(_COUNTS.format(""), "catalog"))
def collection_counts_by_states(spark, d):
    own = collection_states(spark, d)
    return own.merged().crossJoin(F.broadcast(own.rows()))  # one row


@query(sql(_COUNTS.format(" WHERE source_db IS NULL OR source_db NOT IN ('gbif', 'inat')"), "catalog"))
def collection_counts_of_parts(spark, d):
    own = collection_states(spark, d)
    return own.merged(["gbif", "inat"]).crossJoin(F.broadcast(own.rows(["gbif", "inat"])))  # one row


@query(sql("SELECT count(*) AS n_specimens, count(DISTINCT family) AS n_families, count(DISTINCT species) AS n_species, (SELECT count(DISTINCT species) FROM occurrences) AS n_occurrence_species, (SELECT count(DISTINCT species) FROM traits) AS n_trait_species FROM catalog", "catalog", "occurrences", "traits"))
def collection_stats(spark, d):
    return catalog.collection_stats(fx.catalog(spark, d), fx.occurrences(spark, d), fx.traits(spark, d))


@query(sql("SELECT CASE WHEN source_db IN ('gbif','ecdysis','scanbugs') THEN source_db ELSE 'other' END AS source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM catalog GROUP BY 1", "catalog"))
def source_counts(spark, d):
    return catalog.with_share(catalog.source_counts(fx.catalog(spark, d)))


@query(sql("SELECT family, count(*) AS n FROM catalog GROUP BY 1", "catalog"))
def family_counts(spark, d):
    return catalog.family_counts(fx.catalog(spark, d))


@query(sql("SELECT species, count(*) AS n FROM catalog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "catalog"))
def top_species(spark, d):
    return catalog.top_species(fx.catalog(spark, d))


@query(sql("SELECT DISTINCT species FROM occurrences WHERE lower(level0Name) LIKE '%nation_1%' OR lower(countryCode) LIKE '%nation_1%' OR lower(continent) LIKE '%nation_1%' OR lower(locality) LIKE '%nation_1%'", "occurrences"))
def occurrence_location(spark, d):
    return fx.occurrences(spark, d).filter(exprs.location_filter("nation_1")).select("species").distinct()


@query(sql(f"SELECT species, img_id AS imgId, 1.0::DOUBLE AS score FROM catalog JOIN (SELECT DISTINCT {KEY} AS k FROM traits WHERE CanopyAffinity = 'High' AND EdgeAffinity = 'Medium' ORDER BY 1 LIMIT 1000) t ON {KEY} = t.k", "catalog", "traits"))
def trait_tool(spark, d):
    return fusion.search_by_traits(fx.traits(spark, d), fx.catalog(spark, d), CanopyAffinity="High", EdgeAffinity="Medium")


@query(sql("SELECT species, try_cast(CASE WHEN WS_L IN ('NA','null') THEN NULL ELSE WS_L END AS DOUBLE) AS WS_L, try_cast(CASE WHEN FlightDuration IN ('NA','null') THEN NULL ELSE FlightDuration END AS INTEGER) AS FlightDuration, CASE Jan WHEN '0' THEN 'Absent' WHEN '1' THEN 'Present' ELSE 'Unknown' END AS Jan, CASE Voltinism WHEN 'u' THEN 'Univoltine' ELSE 'Multivoltine' END AS VoltinismLabel FROM traits", "traits"))
def trait_decode(spark, d):
    df = taxonomy.decode_traits(fx.traits(spark, d), doubles=["WS_L"], ints=["FlightDuration"])
    return taxonomy.with_trait_labels(df).select("species", "WS_L", "FlightDuration", "Jan", "VoltinismLabel")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id = 0").first()["embedding"]


_DIST = "list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(sql(f"SELECT img_id AS imgId, round({_DIST}, 6) AS distance FROM vectors ORDER BY {_DIST}, img_id LIMIT 50", "vectors"))
def vector_top_k(spark, d):
    return vectors.vector_search(fx.vectors(spark, d), _first_vector(spark, d)).select("imgId", F.round("distance", 6).alias("distance"))


def vector_index(spark, d, metric="cosine"):
    """The stored copy of the vectors in blocks; made by the first query that needs it."""
    path = stored.once(spark, f"vectors-{metric}", [f"{d}/embeddings.parquet"], lambda to: vectorindex.store(fx.vectors(spark, d), to, metric=metric))
    return vectorindex.VectorIndex(spark, path, "embedding", metric)


@query(sql(f"SELECT img_id AS imgId, round({_DIST}, 6) AS distance FROM vectors ORDER BY {_DIST}, img_id LIMIT 50", "vectors"))
def vector_top_k_by_blocks(spark, d):
    return vectorindex.search(vector_index(spark, d), _first_vector(spark, d)).select("imgId", F.round("distance", 6).alias("distance"))


@query(sql(f"SELECT img_id AS imgId, round({_DIST}, 6) AS distance FROM vectors WHERE img_id % 2 = 0 AND {_DIST} <= 0.8 ORDER BY {_DIST}, img_id LIMIT 20", "vectors"))
def vector_within_by_blocks(spark, d):
    found = vectorindex.search(vector_index(spark, d), _first_vector(spark, d), 20, 0.8, fx.vectors(spark, d).filter("img_id % 2 = 0"))
    return found.select("imgId", F.round("distance", 6).alias("distance"))


_FAR = "list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(sql(f"SELECT img_id AS imgId, round({_FAR} * {_FAR}, 5) AS distance FROM vectors ORDER BY {_FAR}, img_id LIMIT 50", "vectors"))
def vector_l2_by_blocks(spark, d):
    return vectorindex.search(vector_index(spark, d, "l2"), _first_vector(spark, d)).select("imgId", F.round("distance", 5).alias("distance"))


@query(sql(f"SELECT species, arg_min(imgId, dist) AS imgId, round(min(dist), 6) AS distance FROM (SELECT img_id AS imgId, {_DIST} AS dist FROM vectors ORDER BY 2, 1 LIMIT 50) JOIN vector_meta ON imgId = img_id GROUP BY 1", "vectors", "vector_meta"))
def vector_best_per_species(spark, d):
    return vectors.search_by_vector(fx.vectors(spark, d), fx.vector_meta(spark, d), _first_vector(spark, d)).select("species", "imgId", F.round("distance", 6).alias("distance"))


_UNIT = """unit AS (SELECT img_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM vectors),
 cent AS (SELECT species, side, list(x ORDER BY i) AS c FROM (SELECT species, class_dv AS side, i, avg(v[i]) AS x FROM unit JOIN vector_meta USING (img_id), range(1, 65) AS r(i) GROUP BY ALL) GROUP BY ALL),
 near AS (SELECT species, side, img_id, list_cosine_distance(c, v) AS dist, row_number() OVER (PARTITION BY species, side ORDER BY round(list_cosine_distance(c, v), 9), img_id) AS r FROM cent, unit),
 best AS (SELECT n.species, side, m.species AS similar_species, min(dist) AS distance FROM near n JOIN vector_meta m USING (img_id) WHERE r <= 800 AND m.species <> n.species GROUP BY ALL)"""


@query(sql("SELECT * FROM (SELECT species, side, similar_species, round(distance, 6) AS distance, row_number() OVER (PARTITION BY species, side ORDER BY distance, similar_species)::INTEGER AS rank FROM best) WHERE rank <= 10", "vectors", "vector_meta").replace(" SELECT * FROM (SELECT species, side, sim", f", {_UNIT} SELECT * FROM (SELECT species, side, sim"))
def batch_similarity(spark, d):
    out = similarity.build_similarity(fx.vectors(spark, d), fx.vector_meta(spark, d))
    return out.select("species", "side", "similar_species", F.round("distance", 6).alias("distance"), "rank")


_ITEM = "SELECT img_id, embedding::DOUBLE[] AS e FROM vectors"
#: Images near the mean vector of up to 100 images of a species, of one side or of both.
_NEAR = """own{n} AS (SELECT img_id FROM (SELECT img_id, class_dv FROM vector_meta WHERE lower(replace(species, '_', '')) = 'genusspecies1' ORDER BY img_id LIMIT 100) WHERE {side}),
 mean{n} AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(e[i]) AS x FROM (SELECT * FROM item JOIN own{n} USING (img_id)), range(1, 65) AS r(i) GROUP BY 1)),
 near{n} AS (SELECT img_id, list_cosine_distance(e, c) AS dist FROM item, mean{n} ORDER BY 2, 1 LIMIT {k}),
 best{n} AS (SELECT species, arg_min(img_id, (dist, img_id)) AS imgId, min(dist) AS distance FROM near{n} JOIN vector_meta USING (img_id) GROUP BY 1)"""
_SIDES = ", ".join(_NEAR.format(n=n, side=f"lower(class_dv) = '{n}'", k=50) for n in ("dorsal", "ventral"))


@query(sql(f"SELECT * FROM (SELECT 'dorsal' AS side, species, imgId, round(distance, 6) AS distance FROM bestdorsal UNION ALL SELECT 'ventral', species, imgId, round(distance, 6) FROM bestventral) WHERE species <> 'Genus_species1'", "vectors", "vector_meta").replace(" SELECT * FROM (SELECT 'dorsal'", f", item AS ({_ITEM}), {_SIDES} SELECT * FROM (SELECT 'dorsal'"))
def similar_species_runtime(spark, d):
    found = similarity.similar_species(fx.vector_meta(spark, d), fx.vectors(spark, d), "genus species1", limit=50)
    return found.select("side", "species", "imgId", F.round("distance", 6).alias("distance"))


_TOK = "list_filter(string_split_regex(translate(lower(coalesce({c}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z]+'), lambda w: w <> '' AND NOT list_contains([{stop}], w))"
_STOP = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
_BM25 = f"""WITH t AS (SELECT doc_id AS id, {_TOK.format(c='text', stop=_STOP)} AS w FROM documents),
 l AS (SELECT id, len(w) AS len FROM t), g AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
 p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM t) WHERE term IN ('heat', 'with', 'rest', 'ofan') GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
 SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score
 FROM p JOIN f USING (term) JOIN l USING (id), g GROUP BY 1"""


def _texts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.col("source").alias("species"))


def text_index(spark, d):
    """The stored index of the documents' texts; made by the first query that needs it."""
    path = stored.once(spark, "text-index", [f"{d}/documents.parquet"], lambda to: fulltext.store_fts(_texts(spark, d), "doc_id", ["text"], to, overwrite=True))
    return fulltext.open_fts(spark, path)


@query(_BM25)
def bm25_scores(spark, d):
    return fulltext.bm25(text_index(spark, d), "Heat, rest ofan!").select("id", F.round("score", 4).alias("score"))


def _ranked(terms: str, unique: bool) -> str:
    """Best 100 rows of documents for the terms, with species and matched fields."""
    scores = _BM25.replace("'heat', 'with', 'rest', 'ofan'", terms).replace("SELECT id, round(", "SELECT id, (").replace(", 4) AS score", ") AS score")
    one = "WHERE r = 1" if unique else ""
    return f"""SELECT species, id, round(score, 4) AS score, CASE WHEN lower(text) LIKE '%heat%' OR lower(text) LIKE '%rest%' OR lower(text) LIKE '%ofan%' THEN ['text'] ELSE [] END AS matched_fields
 FROM (SELECT * FROM (SELECT lower(replace(source, ' ', '_')) AS species, id, score, text, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r
  FROM ({scores}) JOIN documents ON doc_id = id) {one} ORDER BY score DESC, id LIMIT 100) WHERE length(trim(species)) > 0"""


@query(_ranked("'heat', 'rest', 'ofan'", True))
def bm25_unique_species(spark, d):
    return fulltext.fts_search(_texts(spark, d), "doc_id", ["text"], "heat rest ofan", index=text_index(spark, d))


@query(_ranked("'heat', 'rest', 'ofan'", False))
def bm25_all_rows(spark, d):
    return fulltext.fts_search(_texts(spark, d), "doc_id", ["text"], "heat rest ofan", unique=False, index=text_index(spark, d))


@query(_ranked("'heat', 'rest', 'ofan'", False))
def bm25_by_scan(spark, d):
    return fulltext.fts_search(_texts(spark, d), "doc_id", ["text"], "heat rest ofan", unique=False)


@query(f"""WITH t AS (SELECT {_TOK.format(c="text", stop=_STOP)} AS w FROM documents) SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM t) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def text_index_terms(spark, d):
    return text_index(spark, d).terms.select("term", "df").orderBy(F.desc("df"), "term").limit(100)


_SCORED = """SELECT imgId, species, CASE WHEN max(distance) OVER () > min(distance) OVER () THEN 1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) ELSE 1 END AS score"""
_TOOLS = f"""item AS ({_ITEM}), {_NEAR.format(n="", side="true", k=500)}, image AS ({_SCORED} FROM best),
 hit AS (SELECT img_id, list_cosine_distance(e, (SELECT e FROM item WHERE img_id = 0)) AS dist FROM item ORDER BY 2, 1 LIMIT 5000),
 bestText AS (SELECT species, arg_min(img_id, (dist, img_id)) AS imgId, min(dist) AS distance FROM hit JOIN vector_meta USING (img_id) GROUP BY 1),
 text AS ({_SCORED} FROM (SELECT * FROM bestText ORDER BY distance, imgId LIMIT 500))"""
_FUSED = """, r AS (SELECT *, 'text' AS tool FROM text UNION ALL SELECT *, 'image' FROM image),
 k AS (SELECT * FROM r WHERE species IN (SELECT species FROM place)),
 a AS (SELECT (SELECT count(DISTINCT tool) FROM r) + (SELECT count(*) > 0 FROM place WHERE species IN (SELECT species FROM r))::INTEGER AS n)
 SELECT species, arg_min(imgId, (-score, tool, imgId)) AS imgId, round(greatest(0, least(1, sum(score / 2) - 0.15::DOUBLE * (any_value(a.n) - count(DISTINCT tool)))), 4)::DOUBLE AS score, list_sort(list(DISTINCT tool)) AS tool_names
 FROM k, a GROUP BY species ORDER BY score DESC, species LIMIT 50"""


def _with_tools(body: str) -> str:
    return sql("", "vectors", "vector_meta") + f", {_TOOLS}{body}"


@query(_with_tools(", place AS (SELECT DISTINCT species FROM vector_meta WHERE species < 'Genus_species7')" + _FUSED))
def score_fusion(spark, d):
    meta, items = fx.vector_meta(spark, d), fx.vectors(spark, d)
    names = meta.select("species").distinct()
    rank = fusion.Tool("text", "ranking", fusion.search_by_text_vector(items, meta, _first_vector(spark, d)))
    alike = fusion.Tool("image", "ranking", fusion.search_by_image_similarity(items, meta, "Genus_species1"))
    place = fusion.Tool("location", "filter", catalog.images_for_species(meta, names.filter("species < 'Genus_species7'")).withColumn("score", F.lit(1.0)))
    return fusion.fused_search([rank, alike, place])


@query(_with_tools(" SELECT species, imgId, round(score, 6) AS score FROM text"))
def text_vector_tool(spark, d):
    found = fusion.search_by_text_vector(fx.vectors(spark, d), fx.vector_meta(spark, d), _first_vector(spark, d))
    return found.select("species", "imgId", F.round("score", 6).alias("score"))


@query(_with_tools(" SELECT species, imgId, round(score, 6) AS score FROM image"))
def image_similarity_tool(spark, d):
    found = fusion.search_by_image_similarity(fx.vectors(spark, d), fx.vector_meta(spark, d), "Genus_species1")
    return found.select("species", "imgId", F.round("score", 6).alias("score"))


@query(sql("SELECT img_id, x, y, cluster_label, lat, lon FROM (SELECT p.img_id, UMAP1 AS x, UMAP2 AS y, cluster_label, lat, lon, row_number() OVER (PARTITION BY species, cluster_label ORDER BY (lat IS NOT NULL AND lon IS NOT NULL) DESC, p.img_id) AS r FROM projection p JOIN projection_meta USING (img_id)) WHERE r <= 5", "projection", "projection_meta"))
def cluster_sample(spark, d):
    return projection.cluster_sample(fx.projection(spark, d), fx.projection_meta(spark, d))


@query(sql("""SELECT z::INTEGER AS z, tx, ty, count(*) AS n_points FROM (SELECT 0.05 + 0.9 * (UMAP1 - min(UMAP1) OVER ()) / (max(UMAP1) OVER () - min(UMAP1) OVER ()) AS x, 0.05 + 0.9 * (UMAP2 - min(UMAP2) OVER ()) / (max(UMAP2) OVER () - min(UMAP2) OVER ()) AS y FROM projection),
 range(0, 7) AS zs(z), range(0, 64) AS a(tx), range(0, 64) AS b(ty)
 WHERE tx < (1 << z) AND ty < (1 << z) AND x * (1 << z) >= tx - 0.265625 AND x * (1 << z) < tx + 1.265625 AND y * (1 << z) >= ty - 0.265625 AND y * (1 << z) < ty + 1.265625 GROUP BY ALL""", "projection"))
def tile_occupancy(spark, d):
    return projection.tile_counts(projection.tile_index(projection.normalize_xy(fx.points(spark, d)), max_zoom=6))


ZOOMS = sql("""SELECT z::INTEGER AS z, count(*) AS n_tiles, sum(n)::BIGINT AS n_points FROM (SELECT z, tx, ty, count(*) AS n FROM (SELECT z, tx, unnest(range(greatest(0, floor(y * s - 1.265625)::BIGINT + 1), least(s, floor(y * s + 0.265625)::BIGINT + 1))) AS ty
  FROM (SELECT z, y, s, unnest(range(greatest(0, floor(x * s - 1.265625)::BIGINT + 1), least(s, floor(x * s + 0.265625)::BIGINT + 1))) AS tx
  FROM (SELECT 0.05 + 0.9 * (UMAP1 - min(UMAP1) OVER ()) / (max(UMAP1) OVER () - min(UMAP1) OVER ()) AS x, 0.05 + 0.9 * (UMAP2 - min(UMAP2) OVER ()) / (max(UMAP2) OVER () - min(UMAP2) OVER ()) AS y FROM projection), (SELECT z, 1 << z AS s FROM range(0, 10) AS zs(z)))) GROUP BY ALL) GROUP BY z""", "projection")


@query(ZOOMS)
def tile_zooms(spark, d):
    return projection.zoom_counts(projection.tile_layout(projection.tile_index(projection.normalize_xy(fx.points(spark, d)))))


@query(ZOOMS)
def tile_zooms_by_cells(spark, d):
    counts = projection.pyramid_counts(projection.normalize_xy(fx.points(spark, d)))
    return counts.groupBy("z").agg(F.count("*").alias("n_tiles"), F.sum("n_points").alias("n_points"))


@query(sql("SELECT min(UMAP1) - 0.6 AS x_low, max(UMAP1) + 0.6 AS x_high, min(UMAP2) - 0.6 AS y_low, max(UMAP2) + 0.6 AS y_high FROM projection", "projection"))
def plot_bounds(spark, d):
    return projection.plot_bounds(fx.points(spark, d))


@query(sql("SELECT DOI, year FROM works WHERE regexp_matches(title, '(?i)\\bthat\\s+and\\b') OR regexp_matches(abstract, '(?i)\\bthat\\s+and\\b')", "works"))
def work_mentions(spark, d):
    return corpora.mentions(fx.works(spark, d), "That_and").select("DOI", "year")


@query(sql("SELECT DOI, year, relevance FROM works WHERE year >= 1995 AND type = 'journal-article' AND length(trim(abstract)) > 0 ORDER BY relevance DESC, DOI LIMIT 50", "works"))
def works_window(spark, d):
    return corpora.works_filter(fx.works(spark, d)).select("DOI", "year", "relevance")


@query(sql("SELECT coalesce(year::VARCHAR, 'Unknown Year') AS year, count(*) AS n, list(DOI ORDER BY DOI) AS dois FROM works GROUP BY 1", "works"))
def works_by_year(spark, d):
    out = corpora.works_by_year(fx.works(spark, d), ("DOI",))
    return out.select("year", "n", F.transform("works", lambda w: w["DOI"]).alias("dois"))


@query("""WITH r AS (SELECT user_id::VARCHAR AS species, count(*) FILTER (event_type = 'click') AS a, count(*) AS b FROM events GROUP BY 1)
 SELECT species, 'PROTEIN_CODING' AS gene_type, a AS "count", 'Protein Coding' AS label, 'protein' AS category FROM r UNION ALL
 SELECT species, 'lncRNA', b, 'lncRNA', 'rna' FROM r UNION ALL SELECT species, 'pseudo-gene', 0, 'Pseudo Gene', 'pseudo' FROM r UNION ALL
 SELECT species, 'unknown', 7, 'Unknown', 'other' FROM r""")
def gene_counts(spark, d):
    return corpora.gene_counts(fx.gene_reports(spark, d))


@query()
def page_sections(spark, d):
    return corpora.page_sections(spark.read.parquet(f"{d}/pages.parquet"), heading="h1")


@query(sql("SELECT species, img_id, lat, lon FROM (SELECT species, img_id, lat, lon, row_number() OVER (PARTITION BY species ORDER BY img_id) AS r FROM catalog WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE r <= 200", "catalog"))
def occurrence_points(spark, d):
    return corpora.occurrence_points(fx.catalog(spark, d)).select("species", "img_id", "lat", "lon")


@query(sql("SELECT species, count(*) AS n_images, min(img_id) AS main_image FROM catalog WHERE lower(replace(species, '_', '')) = 'x' OR species IN (SELECT species FROM traits WHERE CanopyAffinity = 'Low') GROUP BY 1", "catalog", "traits"))
def images_in_scope(spark, d):
    scope = fx.traits(spark, d).filter(exprs.trait_filter(CanopyAffinity="Low"))
    return catalog.within_species(fx.catalog(spark, d), scope).groupBy("species").agg(F.count("*").alias("n_images"), F.min("img_id").alias("main_image"))


@query(sql(f"SELECT DISTINCT {KEY} AS species_key FROM traits WHERE {KEY} IN (SELECT {KEY} FROM catalog)", "traits", "catalog"))
def existing_species(spark, d):
    return catalog.existing_species(fx.catalog(spark, d), fx.traits(spark, d))


@query(sql(f"SELECT species, {KEY} AS underscore_key, lower(replace(species, '_', '')) AS squeezed_key, list_aggregate((string_split({KEY}, '_'))[1:2], 'string_agg', '_') AS binomial_key, upper(species[1]) || species[2:] AS display_name FROM traits", "traits"))
def name_keys(spark, d):
    return fx.traits(spark, d).select("species", keys.underscore_key("species").alias("underscore_key"), keys.squeezed_key("species").alias("squeezed_key"), keys.binomial_key("species").alias("binomial_key"), keys.display_name("species").alias("display_name"))


@query(sql("SELECT cluster_label, min(img_id) AS img_id FROM projection GROUP BY 1", "projection"))
def cluster_representatives(spark, d):
    return catalog.with_representative(fx.projection(spark, d)).filter("is_representative").select("cluster_label", "img_id")


@query(sql("SELECT c.species, c.family, t.CanopyAffinity, t.Voltinism FROM (SELECT species, min(family) AS family FROM catalog GROUP BY 1) c LEFT JOIN traits t ON lower(c.species) = lower(t.species)", "catalog", "traits"))
def species_profiles(spark, d):
    tax = fx.catalog(spark, d).groupBy("species").agg(F.min("family").alias("family"))
    return taxonomy.species_profile(tax, fx.traits(spark, d)).select("species", "family", "CanopyAffinity", "Voltinism")


@query()
def vector_projection(spark, d):
    return projection.project_2d(fx.vectors(spark, d))
