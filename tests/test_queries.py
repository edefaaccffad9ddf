"""Every registered query of the library against its SQL, and the entry's contract."""

from __future__ import annotations

import datetime
import os

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from taxaspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, name):
    names, rows = oracle.spark_rows(registry.QUERIES[name](spark, small))
    if name in registry.ORACLE_SQL:
        assert (names, rows) == oracle.sql_rows(registry.ORACLE_SQL[name], small)
    assert len(names) == len(set(names))


def test_tile_places_just_below_a_pixel(spark, small, tmp_path):
    """A place that rounding would lift over the next whole pixel is cut like any other."""
    for t in oracle.TABLES:
        if t != "events":
            os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    day = datetime.datetime(2024, 1, 1)
    ts = [day + datetime.timedelta(seconds=x) for x in (0, 43199, 86398)]
    rows = {"event_id": [1, 2, 3], "ts": pa.array(ts, pa.timestamp("us")), "user_id": [1, 2, 3], "event_type": ["a"] * 3, "value": [0.0, 8.67, 560.21], "props": ["{}"] * 3}
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    names, got = oracle.spark_rows(registry.QUERIES["tile_places"](spark, str(tmp_path)))
    assert (names, got) == oracle.sql_rows(registry.ORACLE_SQL["tile_places"], str(tmp_path))
    assert {r[2] for r in got if r[0] == 2 and r[names.index("z")] == 0} == {63}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["species_key", "species", "hit_family", "n"]
    assert df.count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
