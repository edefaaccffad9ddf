"""Registered queries of reading files into tables and keeping keyed tables, each with its SQL.

They write below the shared folder and give what the tables hold in the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.operators import vectors
from taxaspark.plans import fixtures as fx
from taxaspark.plans.registry import query
from taxaspark.sources import stored, tables
from taxaspark.sources.keyed import KeyedTable
from taxaspark.streaming.ingest import stream_ingest

_SUMMARY = "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys, min(c_name) AS first FROM customer GROUP BY 1"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.min("c_name").alias("first"))


def _folder(spark: SparkSession) -> str:
    return f"{stored.shared_dir(spark)}/taxaspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _table(spark: SparkSession, **ingested) -> str:
    name = f"own_{uuid.uuid4().hex}"
    tables.ingest(spark, table=name, **ingested)
    return name


@query(_SUMMARY)
def ingest_parquet(spark, d):
    name = _table(spark, path=f"{d}/nation.parquet")
    return _summary(tables.ingest(spark, f"{d}/customer.parquet", name))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ingest_parquet_if_absent(spark, d):
    name = _table(spark, path=f"{d}/nation.parquet", mode="if_absent")
    return tables.ingest(spark, f"{d}/customer.parquet", name, mode="if_absent").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query(_SUMMARY.replace("GROUP BY", "WHERE c_custkey % 3 = 0 GROUP BY"))
def ingest_frame_if_absent(spark, d):
    own = _read(spark, d, "customer")
    name = _table(spark, path=None, mode="if_absent", df=own.filter("c_custkey % 3 = 0"))
    return _summary(tables.ingest(spark, None, name, mode="if_absent", df=own))


def _written(spark: SparkSession, d: str, sep: str) -> str:
    def make(path: str) -> None:
        _read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("2020-01-02").alias("georeferencedDate")).write.option("header", True).option("sep", sep).csv(f"{path}/rows")

    return stored.once(spark, f"customers-{ord(sep)}", [f"{d}/customer.parquet"], make) + "/rows"


@query(_SUMMARY)
def ingest_csv(spark, d):
    return _summary(tables.ingest(spark, _written(spark, d, ","), _table(spark, path=f"{d}/nation.parquet"), "csv"))


@query(_SUMMARY)
def ingest_csv_if_absent(spark, d):
    name = _table(spark, path=_written(spark, d, ","), fmt="csv", mode="if_absent")
    return _summary(tables.ingest(spark, f"{d}/nation.parquet", name, mode="if_absent"))


@query("SELECT '2020-01-02' AS georeferencedDate, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer")
def ingest_tsv_typed(spark, d):
    name = _table(spark, path=_written(spark, d, "\t"), fmt="tsv", mode="if_absent", types={"georeferencedDate": "string"})
    return spark.table(name).groupBy("georeferencedDate").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT count(*) AS n FROM supplier")
def ingested_count(spark, d):
    n = tables.count_entries(spark, _table(spark, path=f"{d}/supplier.parquet"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def _keyed(spark: SparkSession, d: str, change: Callable[[KeyedTable, DataFrame], KeyedTable], key: str = "o_orderkey") -> DataFrame:
    """The orders but each third, changed by a batch of each second with other values."""
    own = _orders(spark, d)
    table = KeyedTable.create(spark, _folder(spark), own.schema, key, 16)
    table = table.replace(own.filter("o_orderkey % 3 <> 0"), own.select(key).limit(0))
    batch = own.filter("o_orderkey % 2 = 0").withColumn("o_custkey", F.col("o_custkey") + 1_000_000)
    return change(table, batch).read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custs"), F.sum("o_orderkey").alias("keys"))


_KEYED = "SELECT o_orderstatus, count(*) AS n, sum(c)::BIGINT AS custs, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, {} AS c FROM orders) WHERE {} GROUP BY 1"
_NEW = "o_custkey + 1000000"


@query(_KEYED.format(f"CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE {_NEW} END", "o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"))
def keyed_insert_if_absent(spark, d):
    return _keyed(spark, d, lambda t, batch: t.insert_if_absent(batch.unionByName(batch)))


@query(_KEYED.format(f"CASE WHEN o_orderkey % 2 = 0 THEN {_NEW} ELSE o_custkey END", "o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"))
def keyed_upsert(spark, d):
    return _keyed(spark, d, lambda t, batch: t.upsert(batch))


@query("""SELECT o_orderstatus, count(*) AS n, sum(c)::BIGINT AS custs, sum(o_orderkey)::BIGINT AS keys FROM (
 SELECT o_orderstatus, o_custkey AS c, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'F' UNION ALL
 SELECT o_orderstatus, o_custkey + 1000000, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F') GROUP BY 1""")
def keyed_replace(spark, d):
    """All rows of one value go, those of a batch come; the key isn't unique."""
    return _keyed(spark, d, lambda t, batch: t.replace(batch.filter("o_orderstatus = 'F'"), batch.filter("o_orderstatus = 'F'").select("o_orderstatus")), "o_orderstatus")


@query(_KEYED.format(_NEW, "o_orderkey % 2 = 0"))
def keyed_force(spark, d):
    return _keyed(spark, d, lambda t, batch: t.replace(batch, batch.select("o_orderkey"), force=True))


@query("SELECT user_id, min(event_id) AS event_id, count(*) OVER () AS n FROM events GROUP BY user_id")
def streamed_keys(spark, d):
    """Files that arrive in two runs; each user's row of the least event stays, as it comes in the first."""
    events, top = _read(spark, d, "events").select("event_id", "user_id"), _folder(spark)
    first = events.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id")
    for rows in (first, events):
        rows.write.mode("append").parquet(f"{top}/in")
        stream_ingest(spark, f"{top}/in", events.schema, f"{top}/out", f"{top}/check", "user_id").awaitTermination()
    out = KeyedTable.open(spark, f"{top}/out").read()
    return out.crossJoin(F.broadcast(out.agg(F.count("*").alias("n")))).select("user_id", "event_id", "n")  # one row


@query("SELECT count(*) AS n, min(vec_id) AS first FROM embeddings")
def vector_collection(spark, d):
    path, dims = _folder(spark), {"embedding": 64}
    tables.open_vectors(spark, path, dims)
    own = fx.vector_paths(spark, d).join(fx.vectors(spark, d), "img_id")
    rows = own.unionByName(own.limit(5).withColumn("embedding", F.slice("embedding", 1, 3)))
    tables.of_dims(rows, dims).select(F.col("img_id").cast("string").alias("img_id"), "img_path", "embedding").write.mode("append").parquet(path)
    return tables.open_vectors(spark, path, dims).agg(F.count("*").alias("n"), F.min(F.col("img_id").cast("long")).alias("first"))


@query("""SELECT 'genus_' || lower(c_mktsegment) || '_' || c_custkey AS id, 'genus_' || lower(c_mktsegment) AS folder, c_custkey || '.png' AS filename, 'Genus ' || lower(c_mktsegment) AS "scientificName" FROM customer WHERE c_custkey % 4 <> 0""")
def image_entries(spark, d):
    own = _read(spark, d, "customer")
    folder = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("genus_"), F.lower("c_mktsegment"))).otherwise("plain")
    name = F.col("c_custkey").cast("string")
    return tables.metadata_entries(own.select(name.alias("img_id"), folder.alias("folder"), F.concat(F.lit("/img/"), folder, F.lit("/"), name, F.lit(".png")).alias("path")))


@query("""SELECT vec_id AS img_id, CASE WHEN vec_id % 2 = 0 THEN '/static/' || vec_id || '.webp' ELSE '/img/' || vec_id || '.png' END AS full_path,
 CASE WHEN vec_id % 3 = 0 THEN '/static/thumbnails/' || vec_id || '_thumbnail.webp' END AS thumb_path FROM embeddings""")
def media_paths(spark, d):
    own, key = fx.vector_paths(spark, d), F.col("img_id").cast("string")
    full = own.filter("img_id % 2 = 0").select(F.concat(F.lit("/static/"), key, F.lit(".webp")).alias("path"))
    thumb = own.filter("img_id % 3 = 0").select(F.concat(F.lit("file:///static/thumbnails/"), key, F.lit("_thumbnail.webp")).alias("path"))
    return tables.with_media_paths(own, "/static", "webp", full.unionByName(thumb)).select("img_id", "full_path", "thumb_path")


LETTERS = "aeiou"


def _counts():
    return lambda texts: [None if not t else np.array([1.0 + t.count(c) for c in LETTERS]) for t in texts]


_COUNT = ", ".join(f"1.0 + length(text) - length(replace(text, '{c}', ''))" for c in LETTERS)


@query(f"""SELECT doc_id, i, round((v[i + 1] / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 5) AS x FROM (SELECT doc_id, [{_COUNT}]::DOUBLE[] AS v FROM documents WHERE length(text) > 0), (SELECT unnest(range(0, 5))::INTEGER AS i)""")
def embedded_texts(spark, d):
    own = vectors.embed_column(_read(spark, d, "documents"), "text", _counts, len(LETTERS), "doc_id")
    return own.select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))
