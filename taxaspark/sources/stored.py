"""Derived tables that are made once and then read: indexes, statistics, sorted copies.

They lie in the folder that driver and executors share, below the application's name, and are known
by what they are made from: when a source's files change, they are made anew.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset in a local session a temporary
    one is set instead."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at a path, as one digest."""
    fs, where = file_system(spark, path)
    files, found = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def once(spark: SparkSession, name: str, sources: Iterable[str], make: Callable[[str], object]) -> str:
    """Path of what ``make(path)`` stores of the source files; made only if it isn't there. A run that
    failed leaves no mark that it is done, and is made again."""
    known = hashlib.sha1("\n".join(state_of(spark, p) for p in sources).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/taxaspark-{spark.sparkContext.applicationId}/{name}-{known}"
    if not exists(spark, f"{path}/_DONE"):
        make(path)
        fs, done = file_system(spark, f"{path}/_DONE")
        fs.create(done, True).close()
    return path
