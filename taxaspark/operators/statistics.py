"""Statistics of a growing collection from states that are kept for each of its parts.

Names are numbered as they come. A part's state is its number of rows and, for each field, which
names it holds, as bitmaps of their numbers: states are merged by or, so distinct counts stay exact,
a new part costs only its own rows, and a part can be taken out.

Names grow with the collection, so they meet by a shuffle and not by way of the driver; a part's own are
written once, as numbering them reads them several times.

Below the path: ``names`` (field, name, number), ``states`` (part, field, bucket, bits), ``counts`` (part, n),
``held`` (field, name) of the part that came last.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.sources.stored import exists

#: Numbers of the names that came with one part.
STEP = 48
_SCHEMAS = {"names": "field string, name string, number bigint", "states": "part string, field string, bucket bigint, bits binary", "counts": "part string, n bigint"}


@dataclass
class Statistics:
    spark: SparkSession
    path: str
    fields: tuple[str, ...]

    def read(self, table: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).parquet(f"{self.path}/{table}")

    def done(self) -> DataFrame:
        """Parts that are counted: their row in ``counts`` is written last."""
        return self.read("counts").select("part").distinct()

    def add(self, part: str, rows: DataFrame) -> bool:
        """Count a part, named ``part``, unless it is counted. False if it was. A part whose run failed is
        counted anew; what that run left of it is merged again, which changes nothing."""
        if not self.done().filter(F.col("part") == part).isEmpty():
            return False
        step = self.read("names").agg(F.coalesce(F.shiftright(F.max("number"), STEP), F.lit(-1)).alias("step")).first()["step"] + 1
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("name")) for f in self.fields]))
        rows.select(cells.alias("c")).select("c.*").filter("name IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/held")
        held = self.spark.read.schema("field string, name string").parquet(f"{self.path}/held")
        new = held.join(self.read("names").hint("merge"), ["field", "name"], "left_anti").repartitionByRange("field", "name").sortWithinPartitions("field", "name")
        number = F.lit(step).cast("long") * (1 << STEP) + F.monotonically_increasing_id()
        new.select("field", "name", number.alias("number")).write.mode("append").parquet(f"{self.path}/names")
        names = self.read("names").groupBy("field", "name").agg(F.min("number").alias("number"))  # a run that failed may have numbered some
        numbered = held.join(names.hint("merge"), ["field", "name"]).select("field", F.col("number") + 1)
        numbered = numbered.toDF("field", "number")
        bits = numbered.groupBy("field", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        bits.select(F.lit(part).alias("part"), "field", "bucket", "bits").write.mode("append").parquet(f"{self.path}/states")
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        counted.coalesce(1).write.mode("append").parquet(f"{self.path}/counts")
        return True

    def refresh(self, parts: Iterable[tuple[str, DataFrame]]) -> list[str]:
        """Count the parts that aren't counted yet; gives their names. Others aren't read."""
        return [name for name, rows in parts if self.add(name, rows)]

    def merged(self, without: Iterable[str] = ()) -> DataFrame:
        """(field, n_distinct) over all parts but those named in ``without``; null names don't count."""
        kept = self.read("states").join(self.done(), "part", "left_semi").filter(~F.col("part").isin(*without))
        bits = kept.groupBy("field", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        found = bits.groupBy("field").agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))
        every = self.spark.createDataFrame([(f,) for f in self.fields], "field string")  # one row for each field
        return every.join(found, "field", "left").select("field", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))

    def rows(self, without: Iterable[str] = ()) -> DataFrame:
        counts = self.read("counts").filter(~F.col("part").isin(*without)).groupBy("part").agg(F.max("n").alias("n"))
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
