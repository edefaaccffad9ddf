"""Reading files into tables, and keeping keyed tables up to date."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.functions import keys

IMAGE_ENDINGS = r"(?i)\.(png|jpe?g|webp|bmp)$"
MODES = {"replace": "overwrite", "if_absent": "ignore"}


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Parquet, CSV or TSV with a header. Give a schema where it is known: inferring one reads a CSV
    twice. ``types`` forces single columns."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt not in ("csv", "tsv"):
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("quote", '"').option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    inferred = reader.option("inferSchema", True).csv(path).schema
    forced = types or {}
    fields = [T.StructField(f.name, T._parse_datatype_string(forced[f.name]) if f.name in forced else f.dataType) for f in inferred]
    return reader.schema(T.StructType(fields)).csv(path)


def ingest(spark: SparkSession, path: str | None, table: str, fmt: str = "parquet", mode: str = "replace", df: DataFrame | None = None, **options) -> DataFrame:
    """Write a file, or ``df``, as ``table``; ``mode`` "if_absent" leaves a table that exists as it is."""
    source = read(spark, path, fmt, **options) if df is None else df
    source.write.mode(MODES[mode]).saveAsTable(table)
    return spark.table(table)


def count_entries(spark: SparkSession, table: str) -> int | None:
    """Rows of a table, or None if there is none."""
    try:
        return spark.table(table).count()
    except AnalysisException:
        return None


def vector_schema(dims: dict[str, int]) -> T.StructType:
    fields = [T.StructField(c, T.ArrayType(T.FloatType(), containsNull=False)) for c in dims]
    return T.StructType([T.StructField("img_id", T.StringType()), T.StructField("img_path", T.StringType()), *fields])


def open_vectors(spark: SparkSession, path: str, dims: dict[str, int]) -> DataFrame:
    """The vector collection at a path, made empty if there is none."""
    schema = vector_schema(dims)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def of_dims(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Rows whose vectors have the given sizes."""
    for c, n in dims.items():
        df = df.filter(F.size(c) == n)
    return df


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def first_of_key(df: DataFrame, *key: str) -> DataFrame:
    """One row of each key: of several the least by the other columns, in order; as JSON if they hold a
    map, which has no order."""
    on = [F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(key)]
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in key], F.lit(0).alias("_none"))
    row = F.min(others) if _ordered(T.StructType([f for f in df.schema if f.name not in key])) else F.min_by(others, F.to_json(others))
    kept = df.groupBy(*on).agg(row.alias("_row"))
    return kept.select(*[F.col(f"_key{key.index(c)}").alias(c) if c in key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str = "img_id") -> DataFrame:
    """Rows of the batch whose key is new, one of each: what is to be appended."""
    return first_of_key(batch, key).join(target.select(key), key, "left_anti").select(*target.columns)


def upsert(target: DataFrame, batch: DataFrame, key: str = "img_id") -> DataFrame:
    """The target with the batch's rows in place of those of the same key."""
    batch = first_of_key(batch.select(*target.columns), key)
    return target.join(batch.select(key), key, "left_anti").select(*target.columns).unionByName(batch)


def replace_keys(target: DataFrame, batch: DataFrame, keys: DataFrame) -> DataFrame:
    """The target without the rows of ``keys``, and with the batch."""
    on = keys.columns
    return target.join(keys.distinct(), on, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def store_keys(spark: SparkSession, table: str, batch: DataFrame, keys: DataFrame, force: bool = False) -> DataFrame:
    """Store the batch in place of the rows of ``keys``; ``force`` drops what the table held before.

    The new content goes to a folder of its own, and the table's location is set to it then, in one
    step: a run that fails leaves the old content. For large tables see ``keyed.KeyedTable``, which
    rewrites only what the keys touch.
    """
    there = spark.catalog.tableExists(table)
    out = replace_keys(spark.table(table), batch, keys) if there and not force else batch
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table.replace('.', '/')}__{uuid.uuid4().hex}"
    out.write.parquet(folder)
    if there and spark.table(table).schema.simpleString() != out.schema.simpleString():
        raise ValueError(f"{table} has other columns than the batch")
    if there:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, folder, "parquet")
    return spark.table(table)


def scan_images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(img_id, folder, path, size) of the image files below a folder; the first by path if limited."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    files = files.filter(F.col("path").rlike(IMAGE_ENDINGS)).select(keys.image_id("path").alias("img_id"), keys.parent_folder("path").alias("folder"), "path", "size")
    return files.orderBy("path").limit(limit) if limit and limit > 0 else files


def with_media_paths(df: DataFrame, folder: str, fmt: str = "png", files: DataFrame | None = None) -> DataFrame:
    """Adds full_path and thumb_path. With ``files(path)`` those that exist, else the stored img_path
    and null."""
    full = F.concat(F.lit(f"{folder}/"), F.col("img_id").cast("string"), F.lit(f".{fmt}"))
    thumb = F.concat(F.lit(f"{folder}/thumbnails/"), F.col("img_id").cast("string"), F.lit(f"_thumbnail.{fmt}"))
    df = df.withColumns({"full_path": full, "thumb_path": thumb})
    if files is None:
        return df
    there = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("_path")).distinct()
    for c, other in (("full_path", "img_path"), ("thumb_path", None)):
        stored = F.col(other) if other in df.columns else F.lit(None).cast("string")
        found = there.select(F.col("_path").alias(f"_{c}"))
        df = df.join(found, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_{c}", stored)).drop(f"_{c}")
    return df


def metadata_entries(files: DataFrame) -> DataFrame:
    """(id, folder, filename, scientificName); files whose folder gives no name are left out."""
    named = files.select(F.concat_ws("_", "folder", "img_id").alias("id"), "folder", F.substring_index("path", "/", -1).alias("filename"), keys.folder_name("folder").alias("scientificName"))
    return named.filter(F.instr("folder", "_") > 0)


def write_metadata_json(files: DataFrame, path: str) -> tuple[int, int]:
    """One object a line, each a map from the id to its entry. Gives the numbers of files that were
    written and that were left out."""
    entries = metadata_entries(files)
    keyed = entries.select(F.to_json(F.create_map("id", F.struct("id", "folder", "filename", "scientificName"))).alias("value"))
    keyed.write.mode("overwrite").text(path)
    written = files.sparkSession.read.text(path).count()
    return written, files.count() - written
