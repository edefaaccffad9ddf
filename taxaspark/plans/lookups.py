"""Registered queries of the single lookups, expressions and tools, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys
from taxaspark.operators import catalog, corpora, fulltext, projection, taxonomy, vectors
from taxaspark.plans import fixtures as fx
from taxaspark.plans import fusion, similarity
from taxaspark.plans.fixtures import sql
from taxaspark.plans.queries import _DIST, _ITEM, _NEAR, _TOK, _STOP, _UNIT, KEY, _first_vector
from taxaspark.plans.registry import query
from taxaspark.sources import stored

OWN = "lower(replace(species, '_', '')) = 'genusspecies1'"
NAME = "Genus_species1"


@query(sql("SELECT * FROM catalog WHERE img_id = 10", "catalog"))
def meta_by_id(spark, d):
    return catalog.meta_by_id(fx.catalog(spark, d), "10.png")


@query(sql("SELECT class_dv, source_db, count(*) AS n, round(sum(lat), 3) AS lat FROM catalog GROUP BY ALL", "catalog"))
def public_columns(spark, d):
    return catalog.public_meta(fx.catalog(spark, d)).groupBy("class_dv", "source_db").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 3).alias("lat"))


@query(sql(f"SELECT img_id FROM vector_meta WHERE {OWN} ORDER BY 1 LIMIT 100", "vector_meta"))
def species_images(spark, d):
    return catalog.image_ids(fx.vector_meta(spark, d), "genus species1")


@query(sql(f"SELECT img_id, species, source_db, class_dv FROM vector_meta WHERE {OWN} ORDER BY 1 LIMIT 100", "vector_meta"))
def species_image_meta(spark, d):
    return catalog.image_meta_by_species(fx.vector_meta(spark, d), NAME)


@query(sql(f"SELECT min(img_id) AS img_id FROM vector_meta WHERE {OWN}", "vector_meta"))
def species_main_image(spark, d):
    return catalog.main_image(fx.vector_meta(spark, d), NAME)


@query(sql(f"SELECT count(*) AS n_images FROM vector_meta WHERE {OWN}", "vector_meta"))
def species_image_count(spark, d):
    return catalog.image_count(fx.vector_meta(spark, d), NAME)


@query(sql(f"SELECT min(img_id) AS img_id, '/img/' || min(img_id) || '.png' AS img_path FROM vector_meta WHERE {OWN}", "vector_meta"))
def species_image_file(spark, d):
    return catalog.species_image_path(fx.vector_meta(spark, d), fx.vector_paths(spark, d), NAME)


@query("SELECT '/img/7.png' AS img_path FROM embeddings WHERE vec_id = 7")
def image_file(spark, d):
    return catalog.image_path(fx.vector_paths(spark, d), "7")


@query(sql("SELECT event_id AS img_id FROM events WHERE event_id IN (SELECT img_id FROM catalog)", "catalog"))
def known_images(spark, d):
    ids = fx.projection(spark, d).select("img_id")
    return catalog.images_exist(fx.catalog(spark, d), ids)


@query(sql("SELECT * FROM occurrences WHERE lower(species) = 'blue anvil' ORDER BY img_id LIMIT 1", "occurrences"))
def first_occurrence(spark, d):
    return catalog.first_record(fx.occurrences(spark, d), "Blue Anvil")


@query(sql("SELECT species, CanopyAffinity, EdgeAffinity, MoistureAffinity, DisturbanceAffinity, CASE WHEN WS_L NOT IN ('NA', 'null', '') THEN WS_L::DOUBLE END AS WS_L, CASE WHEN FlightDuration NOT IN ('NA', 'null', '') THEN FlightDuration::INTEGER END AS FlightDuration, CASE Jan WHEN '0' THEN 'Absent' WHEN '1' THEN 'Present' ELSE 'Unknown' END AS Jan, Voltinism FROM traits WHERE lower(species) = 'blue anvil'", "traits"))
def trait_record(spark, d):
    return taxonomy.decode_traits(taxonomy.traits_of(fx.traits(spark, d), "BLUE anvil"), doubles=["WS_L"], ints=["FlightDuration"])


@query(sql("SELECT species, count(*) AS n FROM catalog WHERE class_dv = 'dorsal' GROUP BY 1", "catalog"))
def dorsal_images(spark, d):
    return catalog.side_filter(fx.catalog(spark, d), "Dorsal").groupBy("species").agg(F.count("*").alias("n"))


@query(sql(f"SELECT species, count(*) AS n FROM {fx.FLAT} WHERE {KEY} <> 'blue_anvil' GROUP BY 1", "catalog"))
def other_species(spark, d):
    return catalog.exclude_species(fx.catalog(spark, d), "Blue anvil").groupBy("species").agg(F.count("*").alias("n"))


@query(sql("SELECT img_id, lat, lon, coalesce(class_dv, 'Unknown') AS class_dv, coalesce(cluster_label, -1)::INTEGER AS cluster_label FROM (SELECT m.img_id, lat, lon, CASE WHEN m.img_id % 2 = 0 THEN 'dorsal' END AS class_dv, CASE WHEN cluster_label < 3 THEN cluster_label END AS cluster_label FROM projection_meta m JOIN projection USING (img_id)) WHERE lat IS NOT NULL AND lon IS NOT NULL", "projection", "projection_meta"))
def located_points(spark, d):
    df = fx.projection_meta(spark, d).join(fx.projection(spark, d).select("img_id", "cluster_label"), "img_id")
    df = df.select("img_id", "lat", "lon", F.when(F.col("img_id") % 2 == 0, "dorsal").alias("class_dv"), F.when(F.col("cluster_label") < 3, F.col("cluster_label")).alias("cluster_label"))
    return catalog.valid_coords(df)


@query(sql(f"SELECT imgId, round(dist, 6) AS distance FROM (SELECT img_id AS imgId, {_DIST} AS dist FROM vectors WHERE img_id % 2 = 0 ORDER BY 2, 1 LIMIT 50) WHERE dist <= 0.8", "vectors"))
def near_vectors(spark, d):
    items = fx.vectors(spark, d)
    return vectors.vector_search(items, _first_vector(spark, d), max_distance=0.8, within=items.filter("img_id % 2 = 0")).select("imgId", F.round("distance", 6).alias("distance"))


_L2 = "list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(sql(f"SELECT species, arg_min(imgId, (dist, imgId)) AS imgId, round(min(dist), 6) AS distance FROM (SELECT img_id AS imgId, {_L2} ** 2 AS dist FROM vectors ORDER BY 2, 1 LIMIT 50) JOIN vector_meta ON imgId = img_id GROUP BY 1", "vectors", "vector_meta"))
def euclidean_best(spark, d):
    hits = vectors.vector_search(fx.vectors(spark, d), _first_vector(spark, d), metric="l2")
    return vectors.best_per_species(catalog.with_meta(hits, fx.vector_meta(spark, d))).select("species", "imgId", F.round("distance", 6).alias("distance"))


@query(sql("SELECT img_id AS imgId, round(dist, 6) AS distance FROM near", "vectors", "vector_meta").replace(" SELECT img_id AS imgId, round(dist, 6)", f", item AS ({_ITEM}), {_NEAR.format(n='', side='true', k=50)} SELECT img_id AS imgId, round(dist, 6)"))
def near_centroid(spark, d):
    own = catalog.image_ids(fx.vector_meta(spark, d), NAME)
    return vectors.similar_to_ids(fx.vectors(spark, d), own).select("imgId", F.round("distance", 6).alias("distance"))


@query(sql("SELECT species, (i - 1)::INTEGER AS i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM vectors JOIN vector_meta USING (img_id), range(1, 65) AS r(i) GROUP BY ALL", "vectors", "vector_meta"))
def species_centroids(spark, d):
    df = fx.vectors(spark, d).join(fx.vector_meta(spark, d), "img_id")
    return vectors.centroid(df, ["species"]).select("species", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


_TABLE = "SELECT species, side, similar_species, distance, row_number() OVER (PARTITION BY species, side ORDER BY round(distance, 9), similar_species)::INTEGER AS rank FROM best"


def _over_table(body: str) -> str:
    return sql("", "vectors", "vector_meta") + f", {_UNIT}, sim AS (SELECT * FROM ({_TABLE}) WHERE rank <= 10) {body}"


@query(_over_table("SELECT list(similar_species ORDER BY rank) FILTER (side = 'dorsal') AS dorsal, list(similar_species ORDER BY rank) FILTER (side = 'ventral') AS ventral FROM sim WHERE species = 'Genus_species1' AND rank <= 5"))
def similarity_lookup(spark, d):
    table = similarity.build_similarity(fx.vectors(spark, d), fx.vector_meta(spark, d))
    found = similarity.similar_lookup(table, " genus species1 ", limit=5)
    return found.select(*[F.transform(s, lambda e: e["species"]).alias(s) for s in similarity.SIDES])


@query(_over_table("SELECT species, side, similar_species, round(distance, 6) AS distance, rank FROM sim WHERE species IN ('Genus_species1', 'Genus_species2', 'Genus_species3')"))
def similar_many(spark, d):
    items, meta = fx.vectors(spark, d), fx.vector_meta(spark, d)
    some = meta.filter("species in ('Genus_species1', 'Genus_species4')").select("species")
    stored = similarity.build_similarity(items, meta, species=some)
    names = meta.filter("species in ('Genus_species1', 'Genus_species2', 'Genus_species3')").select("species").distinct()
    out = similarity.similar_many(stored, meta, items, names)
    return out.select("species", "side", "similar_species", F.round("distance", 6).alias("distance"), "rank")


@query(_over_table("SELECT side, count(*) AS n, count(DISTINCT species) AS n_species FROM sim GROUP BY ROLLUP (side)"))
def similarity_check(spark, d):
    return similarity.verify_similarity(similarity.build_similarity(fx.vectors(spark, d), fx.vector_meta(spark, d)))


_LOW = "SELECT species FROM traits WHERE CanopyAffinity = 'Low'"


@query(sql(f"SELECT img_id AS imgId FROM catalog WHERE species IN ({_LOW})", "catalog", "traits"))
def images_of_list(spark, d):
    return catalog.image_ids_for_species(fx.catalog(spark, d), fx.traits(spark, d).filter("CanopyAffinity = 'Low'"))


@query(sql("SELECT img_id, species, family FROM catalog WHERE img_id IN (SELECT event_id FROM events WHERE event_type = 'click')", "catalog"))
def meta_of_list(spark, d):
    ids = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'click'").select(F.col("event_id").alias("img_id"))
    return catalog.meta_by_ids(fx.catalog(spark, d), ids).select("img_id", "species", "family")


@query(sql("SELECT nullif(count(DISTINCT species), 0) AS n_species FROM occurrences", "occurrences"))
def occurrence_species_count(spark, d):
    return catalog.count_unique_species(fx.occurrences(spark, d))


_FLAGS = {c: f"coalesce(bool_or(replace({q}, '_', ' ') ILIKE '%male%'), false)" for c, q in {f: '"order"' if f == "order" else f for f in exprs.SEARCH_FIELDS}.items()}


@query(sql(f"SELECT {KEY} AS species_key, min(species) AS species, {', '.join(f'{q} AS hit_{c}' for c, q in _FLAGS.items())}, count(*) AS n FROM catalog GROUP BY 1", "catalog"))
def species_flags(spark, d):
    return catalog.species_matches(fx.catalog(spark, d), catalog.match_flags("male"))


_OCC = ("species", "continent", "countryCode", "stateProvince", "locality", "verbatimLocality", "level1Name")
_OCC_BM25 = sql("", "occurrences") + f""", t AS (SELECT img_id AS id, species, {_TOK.format(c="concat_ws(' ', " + ", ".join(_OCC) + ")", stop=_STOP)} AS w FROM occurrences),
 l AS (SELECT id, len(w) AS len FROM t), g AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
 p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM t) WHERE term IN ('blue', 'anvil', 'building') GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 s AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM p JOIN f USING (term) JOIN l USING (id), g GROUP BY 1)
 SELECT lower(replace(species, ' ', '_')) AS species, round(score, 4) AS score FROM (SELECT species, max(score) AS score FROM s JOIN t USING (id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)"""


@query(_OCC_BM25)
def occurrence_search(spark, d):
    rows = fx.occurrences(spark, d)
    columns = [c for c in fulltext.OCCURRENCE_COLUMNS if c in rows.columns]
    path = stored.once(spark, "occurrence-index", fx.sources(d), lambda to: fulltext.store_fts(rows, "img_id", columns, to, overwrite=True))
    return fulltext.search_occurrences(rows, "blue anvil BUILDING", "img_id", index=fulltext.open_fts(spark, path)).select("species", "score")


_IMAGES = "SELECT img_id AS imgId, species, 1.0::DOUBLE AS score FROM catalog WHERE species IN (SELECT species FROM occurrences WHERE {})"


@query(sql(_IMAGES.format("countryCode = '10' OR upper(level0Name) = '10' OR upper(stateProvince) = '10'"), "catalog", "occurrences"))
def location_tool(spark, d):
    return fusion.search_by_location(fx.occurrences(spark, d), fx.catalog(spark, d), "10").select("imgId", "species", "score")


@query(sql(_IMAGES.format("lower(level0Name) LIKE '%nation_1%'") + f" AND species IN ({_LOW})", "catalog", "occurrences", "traits"))
def location_tool_scoped(spark, d):
    scope = fx.traits(spark, d).filter("CanopyAffinity = 'Low'")
    return fusion.search_by_location(fx.occurrences(spark, d), fx.catalog(spark, d), "NATION_1", within=scope).select("imgId", "species", "score")


@query(sql("SELECT CASE WHEN lower(species) = 'blue' THEN 'species' WHEN lower(genus) = 'blue' THEN 'genus' ELSE 'family' END AS \"matchedCategory\", key, genus, family FROM taxa WHERE lower(species) = 'blue' OR lower(genus) = 'blue' OR lower(family) = 'blue'", "taxa"))
def classified(spark, d):
    return taxonomy.classify(fx.taxa(spark, d), " Blue ").select("matchedCategory", "key", "genus", "family")


@query(sql("SELECT key, '' AS kingdom, '' AS phylum, '' AS class, coalesce(\"order\", '') AS \"order\", family, genus, species, '' AS authorship, coalesce(\"vernacularName\", '') AS \"vernacularName\", coalesce(\"redlistCategory\", 'Unknown') AS \"redlistCategory\", CASE WHEN \"taxonomicStatus\" IS NULL THEN 'Accepted' ELSE 'Synonym' END AS \"taxonomicStatus\" FROM taxa", "taxa"))
def taxonomy_records(spark, d):
    return taxonomy.taxonomy_record(fx.taxa(spark, d))


@query(sql("SELECT t.species, key, coalesce(category, 'Unknown') AS \"redlistCategory\", CanopyAffinity FROM taxa t LEFT JOIN (SELECT p_partkey AS key, min(p_brand) AS category FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) USING (key) LEFT JOIN traits s ON lower(t.species) = lower(s.species) WHERE lower(t.species) = 'blue anvil'", "taxa", "traits"))
def red_list_profile(spark, d):
    red = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("category"))
    return taxonomy.species_profile(fx.taxa(spark, d), fx.traits(spark, d), red, "blue_anvil").select("species", "key", "redlistCategory", "CanopyAffinity")


@query(sql("SELECT key, concat_ws(chr(10) || chr(10), 'Taxonomy Information:' || chr(10) || concat_ws(chr(10), '- Genus: ' || genus, '- Order: ' || \"order\"), 'Traits Information:' || chr(10) || '- Vernacularname: ' || \"vernacularName\", 'Please provide a brief overview of the species based on the above information.') AS text, concat_ws(chr(10), 'genus: ' || genus, 'vernacularName: ' || \"vernacularName\") AS summary FROM taxa", "taxa"))
def profile_texts(spark, d):
    text = taxonomy.profile_text(["genus", "order"], ["vernacularName"])
    return fx.taxa(spark, d).select("key", text.alias("text"), exprs.non_null_summary(["genus", "vernacularName"]).alias("summary"))


@query("SELECT p_partkey AS key, p_size % 3 = 0 AS jan, p_size % 3 <> 0 AS never, CASE p_size % 4 WHEN 0 THEN 'Larva' WHEN 1 THEN 'Pupa or Larva' WHEN 2 THEN 'Adult' ELSE 'No diapause or data unavailable' END AS diapause, CASE p_size % 4 WHEN 0 THEN 'Least Concern' WHEN 1 THEN 'Endangered' ELSE 'Unknown' END AS red_list, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS families FROM part")
def trait_labels(spark, d):
    size = F.col("p_size")
    code = lambda n, *codes: F.get(F.array(*map(F.lit, codes)), size % n)
    months = exprs.month_presence(["Jan", "Feb"])
    families = F.when(size % 2 == 0, F.concat("p_brand", F.lit(" , "), "p_type", F.lit(","))).otherwise(F.col("p_brand"))
    df = spark.read.parquet(f"{d}/part.parquet").withColumns({"Jan": code(3, "Present", "Absent", "?"), "Feb": F.lit("absent")})
    return df.select(
        F.col("p_partkey").alias("key"), F.element_at(months, "Jan").alias("jan"), exprs.all_absent(months).alias("never"), exprs.code_label(code(4, "L", "pl", " a ", "x"), exprs.DIAPAUSE).alias("diapause"),
        exprs.code_label(code(4, "lc", "EN", "?", "??"), exprs.RED_LIST).alias("red_list"), exprs.family_list(families).alias("families"))


@query(sql("SELECT img_id, round(lat - u, 9) AS lat0, round(lat + u, 9) AS lat1, round(lon - u / greatest(cos(radians(lat)), 0.01), 9) AS lon0, round(lon + u / greatest(cos(radians(lat)), 0.01), 9) AS lon1 FROM catalog, (SELECT 50000 / 111100::DOUBLE AS u) WHERE lat IS NOT NULL", "catalog"))
def point_boxes(spark, d):
    df = fx.catalog(spark, d).filter("lat is not null")
    point = exprs.parse_coordinate(F.concat_ws(" ; ", F.col("lat").cast("decimal(9,3)").cast("string"), F.col("lon").cast("decimal(9,3)").cast("string")))
    box = exprs.coordinate_box(F.col("p.lat"), F.col("p.lon"))
    return df.select("img_id", point.alias("p")).select("img_id", box.alias("b")).select("img_id", *[F.round(f"b.{c}", 9).alias(c) for c in ("lat0", "lat1", "lon0", "lon1")])


@query("SELECT event_id AS id, greatest(0, least(100, round(100 * (value / 100))))::INTEGER AS percent, greatest(0, least(100, round(100 * greatest(0, 1 - value / 50))))::INTEGER AS near, round(value / 7, 4) AS score FROM events")
def match_percents(spark, d):
    value = F.col("value")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), exprs.match_percent(value / 100).alias("percent"), exprs.match_percent(value / 50, distance=True).alias("near"), exprs.rounded_score(value / 7).alias("score"))


@query("SELECT p_partkey AS key, upper(p_name[1]) || p_name[2:] AS sentence, 'Ann ' || upper(p_type[1]) || lower(p_type[2:]) || '-' || upper(p_brand[1]) || lower(p_brand[2:]) AS author, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title, '<' || p_brand || '> & é A' AS decoded, 'https://doi.org/10.1/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN replace(p_name, 'blue', '<mark>blue</mark>') ELSE p_name END AS marked FROM part")
def text_forms(spark, d):
    df = spark.read.parquet(f"{d}/part.parquet")
    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    return df.select(
        F.col("p_partkey").alias("key"), exprs.sentence_case(F.upper(name)).alias("sentence"), exprs.author_case(F.concat(F.lit("ann "), kind, F.lit("-"), F.lower(brand))).alias("author"), exprs.title_case(F.upper(name)).alias("title"),
        exprs.decode_entities(F.concat(F.lit("&lt;"), brand, F.lit("&gt; &amp; &#233; &#x41;"))).alias("decoded"), exprs.doi_url(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("url"),
        exprs.highlight(name, "BLUE", size % 2 == 0).alias("marked").alias("marked"))


@query("SELECT p_partkey AS key, upper(p_name[1]) || p_name[2:] AS folder, p_partkey::VARCHAR AS image, replace(p_name, ' ', '_') AS parent FROM part")
def path_keys(spark, d):
    folder = F.translate("p_name", " ", "_")
    path = F.concat(F.lit("/a/"), folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"), keys.folder_name(folder).alias("folder"), keys.image_id(path).alias("image"), keys.parent_folder(path).alias("parent"))


_XY = ", ".join(f"0.05 + 0.9 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {n}" for c, n in (("UMAP1", "x"), ("UMAP2", "y")))


@query(sql(f"""SELECT id, z::INTEGER AS z, tx, ty, round(px, 4) AS px, round(py, 4) AS py, trunc(px - 64)::INTEGER AS paste_x, trunc(py - 64)::INTEGER AS paste_y
 FROM (SELECT *, (x * (1 << z) - tx) * 256 AS px, (y * (1 << z) - ty) * 256 AS py FROM (SELECT img_id AS id, {_XY} FROM projection), range(0, 3) AS zs(z), range(0, 4) AS a(tx), range(0, 4) AS b(ty))
 WHERE tx < (1 << z) AND ty < (1 << z) AND x * (1 << z) >= tx - 0.265625 AND x * (1 << z) < tx + 1.265625 AND y * (1 << z) >= ty - 0.265625 AND y * (1 << z) < ty + 1.265625""", "projection"))
def tile_places(spark, d):
    laid = projection.tile_layout(projection.tile_index(projection.normalize_xy(fx.points(spark, d)), max_zoom=2))
    return laid.select("id", "z", "tx", "ty", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), "paste_x", "paste_y")


@query(sql("SELECT lat, lon FROM catalog WHERE lat IS NOT NULL ORDER BY img_id LIMIT 1", "catalog"))
def map_centre(spark, d):
    return projection.map_center(fx.catalog(spark, d))


@query(sql("SELECT count(DISTINCT cluster_label) AS n_clusters FROM projection JOIN projection_meta USING (img_id)", "projection", "projection_meta"))
def sample_clusters(spark, d):
    return projection.cluster_count(projection.cluster_sample(fx.projection(spark, d), fx.projection_meta(spark, d)))


@query(sql("SELECT DOI, year FROM works WHERE regexp_matches(title, '(?i)\\bthat\\b') OR regexp_matches(abstract, '(?i)\\bthat\\b')", "works"))
def genus_mentions(spark, d):
    return corpora.mentions(fx.works(spark, d), "That_and", "genus").select("DOI", "year")


@query("""SELECT '10.1/' || doc_id AS doi, 'https://doi.org/10.1/' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE 'Study & ' || doc_id END AS title, ['Ann-Lee ' || upper(lang[1]) || lower(lang[2:])] AS authors,
 CASE WHEN doc_id % 3 = 0 THEN 'Unknown Journal' ELSE source END AS journal, CASE WHEN doc_id % 11 <> 0 THEN (1980 + doc_id % 45)::INTEGER END AS year, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '' END AS volume, '' AS issue, '' AS page FROM documents""")
def normalized_works(spark, d):
    return corpora.normalize_works(fx.raw_works(spark, d))
