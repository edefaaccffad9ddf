"""Helpers that the corpus operators share: tables, intermediate results, keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python values at once, or one longer text.
BYTES = 4 << 20
#: ASCII white space, as the operators' word rules define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting that a query's shuffle files go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset (a local session in a test) a temporary folder is taken instead.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; see :func:`release`."""
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: what follows neither repeats the
    work nor depends on blocks that a lost executor held. The shuffles of ``df`` are deleted."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete tables that :func:`cut` gave; nothing that is still to run may read them."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column, split_at: str = SPACE) -> Column:
    """Words between matches of ``split_at``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), split_at), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the faster built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """Tells rows of one id apart by their text; null differs from empty."""
    return F.xxhash64(text, text.isNull())


def in_blocks(df: DataFrame, order: Iterable[str], limit: int, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of ``use(block)`` over blocks of at most about ``limit`` rows of ``df``.

    For a query set that is broadcast: each block has a bounded size, whatever the set's size.
    ``df`` must be stored (see :func:`cut`), as it is counted first.
    """
    n = df.count()
    if n <= limit:
        return use(df)
    blocks = -(-2 * n // limit)
    at = F.pmod(F.xxhash64(*order), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = use(df.filter(at == k))
        out = part if out is None else out.unionByName(part)
    return out


def parts(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``BYTES`` of text in the given columns."""
    sizes = [pc.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False) for k in columns]
    ends = np.cumsum(np.sum(sizes, axis=0), dtype=np.int64)
    k = 0
    while k < len(ends):
        limit = BYTES + (ends[k - 1] if k else 0)
        end = max(k + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(k, end - k)
        k = end
