"""Stored structures for substring search, boxes, pages, statistics and tiles against plain scans."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from taxaspark.functions import exprs
from taxaspark.operators import paged, projection, spatial, statistics, substring
from taxaspark.plans import fixtures, queries, search

NAMES = ["Danaus_plexippus", "danaus plexippus menippe", "Vanessa cardui", "a_b%c", "", None, "Été doré", "İstanbul blue", "x" * 40]


@pytest.fixture(scope="module")
def catalog(spark):
    r = random.Random(3)
    rows = [(k, r.choice(NAMES), r.choice(["Nymphalidae", "Pieridae", None]), r.choice(["male", "female", None])) for k in range(500)]
    return spark.createDataFrame(rows, "img_id long, species string, family string, sex string")


@pytest.fixture(scope="module")
def index(catalog, tmp_path_factory):
    return substring.store(catalog, str(tmp_path_factory.mktemp("s") / "i"))


QUERIES = ["plex", "PLEXIPPUS", "s_p", "s p", "a", "", "%", "dan%pus", "n%s%m", "été", "DORÉ", "istanbul", "i̇stan", "xxxxx", "nowhere", "a_b%c", "male", "_", "\\"]


@pytest.mark.parametrize("query", QUERIES)
def test_substring_equals_the_scan(catalog, index, query):
    want = catalog.filter(exprs.field_match("species", query)).groupBy("species").count().collect()
    got = substring.matching(index, query, ["species"]).collect()
    assert {(r["value"], r["n"]) for r in got} == {(r[0], r[1]) for r in want}


def test_rows_are_counted_without_reading_them(index, catalog):
    assert substring.match_count(index, "plex", "species").first()["n"] == catalog.filter(exprs.field_match("species", "plex")).count()


@pytest.mark.parametrize("query,few", [("plex", 1000), ("s_p", 1), ("male", 1), ("nowhere", 1000)])
def test_search_with_an_index(catalog, index, query, few, monkeypatch):
    monkeypatch.setattr(substring, "FEW", few)
    for field in ("species", "all"):
        scan, own = search.search_catalog(catalog, query, field), search.search_catalog(catalog, query, field, index=index)
        assert own.total.collect() == scan.total.collect()
        assert own.species.collect() == scan.species.collect()
        assert own.specimens.collect() == scan.specimens.collect()


def test_all_fields_agree(catalog):
    """The predicate over all fields, as the search puts it together and by itself."""
    names = ("species", "family", "sex")
    for query in ("male", "dae", "plex"):
        total = search.search_catalog(catalog, query).total.first()["n"]
        assert catalog.filter(exprs.any_field_match(query, names)).count() == total


def test_pieces_reach_the_scan(index):
    plan = substring.matching(index, "plexippus", ["species"])._jdf.queryExecution().executedPlan().toString()
    assert "In(piece, [" in plan or "piece IN (" in plan


BOXES = [(-10, 10, -10, 10), (34.0, 34.5, -119, -118), (-90, 90, -180, 180), (5, 5, 5, 5), (10, -10, 0, 1), (89.9, 95, 170, 200), (0.000001, 0.000002, 0, 180)]


def test_boxes(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, r.choice([None, r.uniform(-95, 95), 5.0, float("nan"), 90.0]), r.choice([None, r.uniform(-190, 190), 5.0, -180.0, 180.0])) for k in range(4000)]
    df = spark.createDataFrame(rows, "img_id long, lat double, lon double")
    placed = spatial.store(df, str(tmp_path / "p"))
    assert placed.count() == 4000
    for box in BOXES:
        want = df.filter(exprs.bbox(*box) & ~F.isnan("lat"))
        assert sorted(x["img_id"] for x in placed.filter(spatial.in_box(*box)).collect()) == sorted(x["img_id"] for x in want.collect())
        ranges = spatial.key_ranges(*box)
        assert len(ranges) <= spatial.RANGES and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))


def test_a_box_reads_few_row_groups(spark, tmp_path):
    df = spark.range(200_000).select("id", (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    conf = {"parquet.block.size": 65536, "parquet.page.size": 8192}
    hadoop = spark._jsc.hadoopConfiguration()
    for k, v in conf.items():
        hadoop.set(k, str(v))
    try:
        spatial.store(df, str(tmp_path / "p"))
    finally:
        for k in conf:
            hadoop.unset(k)
    ranges, read, whole = spatial.key_ranges(34.0, 35.0, -119.0, -117.5), 0, 0
    for f in (tmp_path / "p").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = [meta.schema.column(k).name for k in range(meta.num_columns)].index(spatial.KEY)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(column).statistics
            whole += 1
            read += any(a <= s.max and b >= s.min for a, b in ranges)
    assert whole >= 16 and 1 <= read <= whole // 4
    plan = spark.read.parquet(str(tmp_path / "p")).filter(spatial.in_box(34.0, 35.0, -119.0, -117.5))._jdf.queryExecution().executedPlan().toString()
    assert "Or(Or(" in plan.split("PushedFilters")[1]


def test_pages(spark, tmp_path):
    r = random.Random(5)
    df = spark.createDataFrame([(k, r.choice(["a", "b", None, "c c"]), r.random()) for k in range(1003)], "id long, name string, v double")
    table = paged.store(df, str(tmp_path / "t"), "name", "id", parts=7)
    want = [tuple(x) for x in df.orderBy(F.col("name").asc_nulls_first(), "id").collect()]
    got = [tuple(x) for n in range(1, 13) for x in paged.page(table, n, 97).select("id", "name", "v").collect()]
    assert got == want
    assert table.parts.count() == 7
    for n in (1, 5, 11):
        files = paged.page(table, n, 97).inputFiles()
        assert 1 <= len({f.split("_part=")[1].split("/")[0] for f in files}) <= 2
    after, at = [], want[0]
    for _ in range(12):
        own = [tuple(x) for x in paged.page_after(table, (at[1], at[0]), 97).select("id", "name", "v").collect()]
        after += own
        if own:
            at = own[-1]
    assert after == want[1:]
    assert [x["id"] for x in paged.page_after(table, ("b", -1), 2).collect()] == [x[0] for x in want if x[1] == "b"][:2]
    assert paged.page_after(table, ("zz", 1)).count() == 0
    with pytest.raises(ValueError, match="columns"):
        paged.page_after(table, ("a",))
    empty = paged.store(df.limit(0), str(tmp_path / "e"), "id")
    assert paged.page(empty).count() == 0


def test_statistics(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    parts = {f"p{k}": [(r.choice([None, *"abcdef"]), r.randrange(40)) for _ in range(60)] for k in range(4)}
    frame = lambda k: spark.createDataFrame(parts[k], "family string, `s.x` int")
    own = statistics.Statistics(spark, str(tmp_path / "s"), ("family", "s.x"))

    def check(names, without=()):
        rows = [x for n in names for x in parts[n]]
        got = {x["field"]: x["n_distinct"] for x in own.merged(without).collect()}
        assert got == {"family": len({a for a, _ in rows} - {None}), "s.x": len({b for _, b in rows})}
        assert own.rows(without).first()["n_rows"] == len(rows)

    check([])
    assert own.refresh((k, frame(k)) for k in ("p0", "p1")) == ["p0", "p1"]
    check(["p0", "p1"])
    read = []
    assert own.refresh((k, read.append(k) or frame(k)) for k in parts) == ["p2", "p3"]
    check(parts)
    check(["p1", "p3"], ["p0", "p2"])
    parts["p4"] = [("new", 99)]
    write = statistics.Statistics.read
    monkeypatch.setattr(statistics.Statistics, "read", lambda self, t: 1 / 0 if t == "names" and read.append(t) is None and read.count("names") == 3 else write(self, t))
    with pytest.raises(ZeroDivisionError):  # the names are written, the state isn't
        own.add("p4", frame("p4"))
    monkeypatch.undo()
    check(["p0", "p1", "p2", "p3"])
    assert own.add("p4", frame("p4")) and not own.add("p4", frame("p4"))
    check(parts)


def test_growing_tables_do_not_pass_the_driver(spark, small, tmp_path, monkeypatch):
    """Customers and parts meet orders by a shuffle, and the catalog is made once for all parts."""
    plan = fixtures.catalog(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("SortMergeJoin") == 2
    made, catalog = [], fixtures.catalog
    monkeypatch.setattr(fixtures, "catalog", lambda *a: made.append(a) or catalog(*a))
    monkeypatch.setattr(queries.stored, "once", lambda spark, name, sources, make: make(str(tmp_path / name)) or str(tmp_path / name))
    own = queries.collection_states(spark, small)
    assert len(made) == 1
    assert own.rows().first()["n_rows"] == catalog(spark, small).count()


def test_tiles_by_cells(spark):
    r = random.Random(2)
    points = [(k, r.random(), r.choice([0.0, 1.0, 0.5, r.random()])) for k in range(300)] + [(900, 0.05, 0.95), (901, 0.05, 0.95)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    for zoom in (0, 3, 9):
        rows = lambda out: sorted(map(tuple, out.select("z", "tx", "ty", "n_points").collect()))
        assert rows(projection.pyramid_counts(df, zoom)) == rows(projection.tile_counts(projection.tile_index(df, zoom)))
