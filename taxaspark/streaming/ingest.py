"""Incremental ingest: each key of the files that arrive becomes one row of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from taxaspark.sources.keyed import KeyedTable

WRITER = "stream"


def stream_ingest(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, key: str = "img_id", fmt: str = "parquet", buckets: int = 64) -> StreamingQuery:
    """Start a query that adds rows with new keys to the keyed table at ``target`` and ends when all
    files present are read.

    A batch reads the keys of the buckets that its own keys fall in, and rewrites nothing. The table
    keeps the number of the last batch of each checkpoint, so a batch that runs again, after a crash
    at any point, adds nothing twice.
    """
    KeyedTable.create(spark, target, schema, key, buckets)
    writer = f"{WRITER}:{checkpoint}"

    def add(batch: DataFrame, number: int) -> None:
        KeyedTable.open(batch.sparkSession, target).insert_if_absent(batch, writer, number).compact()

    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
