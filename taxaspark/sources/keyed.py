"""Tables whose rows are found by key: dealt to buckets by a hash of it, changed bucket by bucket.

A change reads and writes only the buckets that its keys fall in. Its files go to a folder of their
own; then a new manifest (which folders a bucket consists of) is moved to its name, in one step, and
the change is there. A run that fails before leaves the table as it was; folders that no manifest
names are deleted by ``vacuum``. A manifest also keeps the last batch that each writer has applied, so
that a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.sources.stored import exists, file_system
from taxaspark.sources.tables import first_of_key

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        self.key: list[str] = manifest["key"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: str | list[str], buckets: int = 64) -> KeyedTable:
        """An empty table of rows that ``key`` finds (one row or many of each); the one at the path if
        there is one. ``buckets`` should let a bucket be read by a task or a few."""
        if exists(spark, f"{path}/manifests"):
            return cls.open(spark, path)
        names = [key] if isinstance(key, str) else list(key)
        if set(names) - set(schema.names):
            raise ValueError(f"no such columns: {set(names) - set(schema.names)}")
        table = cls(spark, path, {"version": 0, "schema": schema.json(), "key": names, "buckets": buckets, "parts": {}, "applied": {}})
        return table._commit(table.manifest | {"version": 1})

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
        """The table as it is, or as it was at a version whose files are still there."""
        if version is None:
            fs, where = file_system(spark, f"{path}/manifests")
            version = max(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit())
        lines = spark.read.text(f"{path}/manifests/{version}", wholetext=True).first()
        return cls(spark, path, json.loads(lines["value"]))

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = self.manifest["parts"] if buckets is None else {str(b): self.manifest["parts"].get(str(b), []) for b in buckets}
        folders = [f"{self.path}/{p}" for parts in wanted.values() for p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.manifest["buckets"])).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # as many as there are buckets

    def insert_if_absent(self, batch: DataFrame, writer: str | None = None, token: int = 0) -> KeyedTable:
        """Adds the batch's rows whose key is new, one of each (see ``first_of_key``). Files that are
        there stay; of the buckets met only the keys are read."""
        if self._applied(writer, token):
            return self
        batch = first_of_key(batch.select(*self._columns()), *self.key)
        met = self.buckets_of(batch)
        new = self._without(batch, self.read(met).select(*[F.col(f"`{k}`") for k in self.key]))
        return self._change(new, [], writer, token)

    def upsert(self, batch: DataFrame, writer: str | None = None, token: int = 0) -> KeyedTable:
        """Puts one row of each key of the batch in place of the table's rows with that key."""
        if self._applied(writer, token):
            return self
        batch = first_of_key(batch.select(*self._columns()), *self.key)
        return self.replace(batch, batch.select(*[F.col(f"`{k}`") for k in self.key]), writer=writer, token=token)

    def replace(self, batch: DataFrame, keys: DataFrame, force: bool = False, writer: str | None = None, token: int = 0) -> KeyedTable:
        """Deletes the rows of ``keys`` and adds the batch; ``force`` deletes all rows."""
        if self._applied(writer, token):
            return self
        batch = batch.select(*self._columns())
        if force:
            return self._change(batch, list(range(self.manifest["buckets"])), writer, token)
        gone = self.buckets_of(keys)
        kept = self._without(self.read(gone), keys)
        return self._change(kept.unionByName(batch), gone, writer, token)

    def compact(self, most: int = 8) -> KeyedTable:
        """Rewrites the buckets that consist of more than ``most`` folders."""
        many = [int(b) for b, parts in self.manifest["parts"].items() if len(parts) > most]
        return self._change(self.read(many), many, None, 0) if many else self

    def vacuum(self) -> int:
        """Deletes the folders that this version doesn't name, and older manifests; gives their number.
        No other writer may be at work, and no reader on an older version."""
        named = {p.split("/")[1] for parts in self.manifest["parts"].values() for p in parts}
        gone = 0
        for folder, kept in (("data", named), ("manifests", {str(self.manifest["version"])})):
            if exists(self.spark, f"{self.path}/{folder}"):
                fs, where = file_system(self.spark, f"{self.path}/{folder}")
                for f in fs.listStatus(where):
                    if f.getPath().getName() not in kept:
                        gone += fs.delete(f.getPath(), True)
        return gone

    def _columns(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.schema.names]

    def _applied(self, writer: str | None, token: int) -> bool:
        return writer is not None and self.manifest["applied"].get(writer, -1) >= token

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        names = [f"_key{n}" for n in range(len(self.key))]
        gone = keys.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(self.key, names)]).distinct()
        return rows.join(gone, reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(self.key, names)]), "left_anti")

    def _change(self, rows: DataFrame, emptied: list[int], writer: str | None, token: int) -> KeyedTable:
        """The table with ``rows`` added and, of the buckets in ``emptied``, nothing else left."""
        written = self._write(rows)
        parts = {b: list(p) for b, p in self.manifest["parts"].items() if int(b) not in emptied}
        for b, folder in written.items():
            parts.setdefault(b, []).append(folder)
        applied = self.manifest["applied"] | ({writer: token} if writer is not None else {})
        return self._commit(self.manifest | {"version": self.manifest["version"] + 1, "parts": parts, "applied": applied})

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows to a new folder; gives each bucket's part of it."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)  # a large bucket is written by several tasks
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        fs, where = file_system(self.spark, f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, manifest: dict) -> KeyedTable:
        """Moves a new manifest to its name. Of two writers that began at the same version one fails."""
        final = f"{self.path}/manifests/{manifest['version']}"
        fs, draft = file_system(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, name = file_system(self.spark, final)
        if fs.exists(name) or not fs.rename(draft, name):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")
        return KeyedTable(self.spark, self.path, manifest)
