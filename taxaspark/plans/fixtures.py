"""The library's tables, derived from the generic tables that the tests and benches are given.

Each view is a plain projection or join of whole tables; ``SQL`` holds the same views for an
independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(d: str) -> list[str]:
    """The files that the catalog and the occurrences are made from."""
    return [f"{d}/{t}.parquet" for t in ("orders", "customer", "nation", "region", "part")]


def _specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region, part = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region", "part"))
    customer, part = customer.hint("merge"), part.hint("merge")  # they grow with the orders, so not by way of the driver
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = part.agg(F.count("*").alias("n_parts"))  # one row; orders are dealt to all parts
    return df.crossJoin(F.broadcast(parts)).join(part, F.col("p_partkey") == F.col("o_orderkey") % F.col("n_parts"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    located = key % 7 != 0
    source = F.create_map(*map(F.lit, ("1-URGENT", "gbif", "2-HIGH", "ecdysis", "3-MEDIUM", "scanbugs", "4-NOT SPECIFIED", "inat")))
    return _specimens(spark, sf_dir).select(
        key.alias("img_id"), F.col("p_name").alias("species"), F.col("p_type").alias("family"), F.split("p_name", " ")[0].alias("genus"),
        F.col("p_brand").alias("order"), F.col("c_name").alias("common_name"),
        F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "male").alias("sex"),
        F.try_element_at(source, F.col("o_orderpriority")).alias("source_db"), F.when(key % 2 == 0, "dorsal").otherwise("ventral").alias("class_dv"),
        F.when(located, (key * 7919 + cust * 104729) % 180000 / 1000.0 - 90).alias("lat"), F.when(located, (key * 15485863 + cust * 7907) % 360000 / 1000.0 - 180).alias("lon"),
        F.lit("Animalia").alias("kingdom"), F.lit("Arthropoda").alias("phylum"), F.lit("Insecta").alias("class"), F.lit("adult").alias("life_stage"),
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {"countryCode": F.substring("n_name", 8, 30), "level0Name": F.col("n_name"), "continent": F.col("r_name"), "stateProvince": F.col("c_mktsegment"), "locality": F.col("c_name"), "level1Name": F.col("r_name"), "verbatimLocality": F.col("c_name")}
    return _specimens(spark, sf_dir).select(F.col("o_orderkey").alias("img_id"), F.col("p_name").alias("species"), *[c.alias(k) for k, c in text.items()])


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda n: F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low"))), ((F.col("size") + n) % 3 + 1).cast("int"))
    own = _read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("species")).agg(F.min("p_size").alias("size"), F.min("p_retailprice").alias("price"))
    return own.select(
        "species", level(0).alias("CanopyAffinity"), level(1).alias("EdgeAffinity"), level(2).alias("MoistureAffinity"), level(3).alias("DisturbanceAffinity"),
        F.when(F.col("size") % 5 == 0, "NA").otherwise(F.col("size").cast("string")).alias("WS_L"), F.when(F.col("size") % 4 == 0, "null").otherwise(F.col("size").cast("string")).alias("FlightDuration"),
        (F.col("size") % 3).cast("string").alias("Jan"), F.when(F.col("size") % 2 == 0, "u").otherwise("m").alias("Voltinism"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding")


def vector_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.concat(F.lit("/img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("img_path"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy table: a record of each part, with gaps."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    return _read(spark, sf_dir, "part").select(
        key.alias("key"), none.alias("kingdom"), none.alias("phylum"), none.alias("class"), F.when(key % 3 != 0, F.col("p_brand")).alias("order"), F.col("p_type").alias("family"),
        F.split("p_name", " ")[0].alias("genus"), F.col("p_name").alias("species"), none.alias("authorship"), F.when(key % 4 != 0, F.col("p_brand")).alias("vernacularName"),
        F.when(key % 2 == 0, F.col("p_type")).alias("redlistCategory"), F.when(key % 5 == 0, "SYNONYM").alias("taxonomicStatus"))


def vector_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("img_id"), F.concat(F.lit("Genus_species"), F.col("label").cast("string")).alias("species"), F.lit("gbif").alias("source_db"), F.when(F.col("vec_id") % 2 == 0, "dorsal").otherwise("ventral").alias("class_dv"))


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("img_id"), F.col("value").alias("UMAP1"), F.expr("cast(unix_timestamp(ts) % 86400 as double)").alias("UMAP2"), (F.col("user_id") % 5).cast("int").alias("cluster_label"))


def projection_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("img_id"), F.col("event_type").alias("species"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("lat"), F.col("value").alias("lon"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection(spark, sf_dir).select(F.col("img_id").alias("id"), F.col("UMAP1").alias("x"), F.col("UMAP2").alias("y"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    year = F.when(F.col("doc_id") % 11 != 0, (1980 + F.col("doc_id") % 45).cast("int"))
    return d.select(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("DOI"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"), year.alias("year"), F.when(F.col("doc_id") % 3 == 0, "book").otherwise("journal-article").alias("type"), (F.col("n_chars") % 1000).alias("relevance"))


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as a service gives them: nested, and with gaps."""
    key = F.col("doc_id")
    title = F.when(key % 5 != 0, F.array(F.concat(F.lit("STUDY &amp; "), key.cast("string"))))
    year = F.when(key % 11 != 0, F.array(F.array((1980 + key % 45).cast("string"))))
    author = F.array(F.struct(F.lit("ann-lee").alias("given"), F.col("lang").alias("family")))
    return _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("10.1/"), key.cast("string")).alias("DOI"), title.alias("title"), author.alias("author"), F.when(key % 3 != 0, F.array("source")).alias("container-title"),
        F.struct(year.alias("date-parts")).alias("published"), F.when(key % 2 == 0, "1").alias("volume"), F.lit(None).cast("string").alias("issue"), F.lit(None).cast("string").alias("page"))


def gene_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_type", "user_id").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count("*").alias("b"))
    json = F.format_string('{"gene_counts":[{"gene_type":"PROTEIN_CODING","count":"%d"},{"gene_type":"lncRNA","count":"%d"},{"gene_type":"pseudo-gene","count":"x"},{"count":"7"}]}', "a", "b")
    return e.select(F.col("user_id").cast("string").alias("species"), json.alias("json"))


#: The views as SQL, by name.
SQL = {
    "catalog": """SELECT o_orderkey AS img_id, p_name AS species, p_type AS family, split_part(p_name, ' ', 1) AS genus, p_brand AS "order",
        c_name AS common_name, CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END AS sex,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'gbif' WHEN '2-HIGH' THEN 'ecdysis' WHEN '3-MEDIUM' THEN 'scanbugs' WHEN '4-NOT SPECIFIED' THEN 'inat' END AS source_db,
        CASE WHEN o_orderkey % 2 = 0 THEN 'dorsal' ELSE 'ventral' END AS class_dv,
        CASE WHEN o_orderkey % 7 <> 0 THEN ((o_orderkey * 7919 + o_custkey * 104729) % 180000)::DOUBLE / 1000.0::DOUBLE - 90 END AS lat,
        CASE WHEN o_orderkey % 7 <> 0 THEN ((o_orderkey * 15485863 + o_custkey * 7907) % 360000)::DOUBLE / 1000.0::DOUBLE - 180 END AS lon,
        'Animalia' AS kingdom, 'Arthropoda' AS phylum, 'Insecta' AS class, 'adult' AS life_stage
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "occurrences": """SELECT o_orderkey AS img_id, p_name AS species, substr(n_name, 8, 30) AS countryCode, n_name AS level0Name, r_name AS continent,
        c_mktsegment AS stateProvince, c_name AS locality, r_name AS level1Name, c_name AS verbatimLocality
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "traits": """SELECT species, (['High','Medium','Low'])[size % 3 + 1] AS CanopyAffinity, (['High','Medium','Low'])[(size + 1) % 3 + 1] AS EdgeAffinity,
        (['High','Medium','Low'])[(size + 2) % 3 + 1] AS MoistureAffinity, (['High','Medium','Low'])[(size + 3) % 3 + 1] AS DisturbanceAffinity,
        CASE WHEN size % 5 = 0 THEN 'NA' ELSE size::VARCHAR END AS WS_L, CASE WHEN size % 4 = 0 THEN 'null' ELSE size::VARCHAR END AS FlightDuration,
        (size % 3)::VARCHAR AS Jan, CASE WHEN size % 2 = 0 THEN 'u' ELSE 'm' END AS Voltinism
        FROM (SELECT p_name AS species, min(p_size) AS size FROM part GROUP BY p_name)""",
    "taxa": """SELECT p_partkey AS key, NULL AS kingdom, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS "order", p_type AS family, split_part(p_name, ' ', 1) AS genus, p_name AS species,
        CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS "vernacularName", CASE WHEN p_partkey % 2 = 0 THEN p_type END AS "redlistCategory",
        CASE WHEN p_partkey % 5 = 0 THEN 'SYNONYM' END AS "taxonomicStatus" FROM part""",
    "vectors": "SELECT vec_id AS img_id, embedding FROM embeddings",
    "vector_meta": """SELECT vec_id AS img_id, 'Genus_species' || label::VARCHAR AS species, 'gbif' AS source_db,
        CASE WHEN vec_id % 2 = 0 THEN 'dorsal' ELSE 'ventral' END AS class_dv FROM embeddings""",
    "projection": """SELECT event_id AS img_id, value AS UMAP1, (floor(epoch(ts))::BIGINT % 86400)::DOUBLE AS UMAP2, (user_id % 5)::INTEGER AS cluster_label FROM events""",
    "projection_meta": "SELECT event_id AS img_id, event_type AS species, CASE WHEN event_id % 3 <> 0 THEN value END AS lat, value AS lon FROM events",
    "works": """SELECT '10.1/' || doc_id::VARCHAR AS DOI, split_part(text, chr(10), 1) AS title, text AS abstract,
        CASE WHEN doc_id % 11 <> 0 THEN (1980 + doc_id % 45)::INTEGER END AS year,
        CASE WHEN doc_id % 3 = 0 THEN 'book' ELSE 'journal-article' END AS type, n_chars % 1000 AS relevance FROM documents""",
}


_FIRST = ", ".join(f'any_value({c}) AS {c}' for c in ("species", "family", '"order"', "common_name", "sex", "source_db", "class_dv", "kingdom", "phylum", "class", "life_stage"))
#: The catalog by way of an aggregate: the engine fails on a condition on texts that come from a join as they lie in the files.
FLAT = f"(SELECT img_id, {_FIRST} FROM catalog GROUP BY img_id)"


def sql(body: str, *views: str) -> str:
    """``body`` over the named views."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + body
