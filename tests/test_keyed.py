"""Keyed tables against a plain dictionary, and against runs that fail between their steps."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from taxaspark.sources import keyed, tables
from taxaspark.sources.keyed import KeyedTable
from taxaspark.streaming.ingest import stream_ingest

SCHEMA = "img_id string, `v.x` int, tags map<string,int>"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, {"n": v}) for k, v in rows], SCHEMA)


def content(table):
    return sorted(((r["img_id"], r["v.x"]) for r in table.read().collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark, str(tmp_path / "t"), frame(spark, []).schema, "img_id", 8)


def test_changes(spark, table):
    """As a dictionary would change; null is a key too."""
    r, want = random.Random(2), {}
    for step in range(5):
        rows = [(r.choice([None, *[f"k{n}" for n in range(25)]]), r.randrange(50)) for _ in range(12)]
        first = defaultdict(list)
        for k, v in rows:
            first[k].append(v)
        least = {k: min(v, key=lambda x: f'{{"v.x":{x},"tags":{{"n":{x}}},"_none":0}}') for k, v in first.items()}  # maps: as JSON
        if step % 2:
            want |= least
            table = table.upsert(frame(spark, rows))
        else:
            want = least | want
            table = table.insert_if_absent(frame(spark, rows))
        assert content(table) == sorted(want.items(), key=repr)
    assert content(KeyedTable.open(spark, table.path)) == content(table)
    table = table.compact(1)
    assert max(map(len, table.manifest["parts"].values())) == 1 and content(table) == sorted(want.items(), key=repr)
    assert table.vacuum() > 0 and table.vacuum() == 0
    assert content(KeyedTable.open(spark, table.path)) == sorted(want.items(), key=repr)
    assert content(table.replace(frame(spark, [("a", 1), ("a", 1)]), frame(spark, []).select("img_id"), force=True)) == [("a", 1), ("a", 1)]


def test_many_rows_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", s, n) for s in ("dorsal", "ventral") for n in range(5)] + [("b", "dorsal", 9)], "species string, side string, rank int")
    t = KeyedTable.create(spark, str(tmp_path / "s"), rows.schema, ["species", "side"]).replace(rows, rows)
    t = t.replace(rows.filter("rank = 0"), rows.filter("species = 'a' and side = 'dorsal'").select("side", "species"))
    assert sorted((r["species"], r["side"], r["rank"]) for r in t.read().collect()) == sorted([("a", "ventral", n) for n in range(5)] + [("a", "dorsal", 0), ("a", "ventral", 0), ("b", "dorsal", 9)])
    with pytest.raises(ValueError, match="no such columns"):
        KeyedTable.create(spark, str(tmp_path / "u"), rows.schema, "img_id")


def test_only_touched_buckets_change(spark, table):
    table = table.insert_if_absent(frame(spark, [(f"k{n}", n) for n in range(60)]))
    before = table.manifest["parts"]
    batch = frame(spark, [("k7", 100)])
    (met,) = table.buckets_of(batch)
    after = table.upsert(batch).manifest["parts"]
    assert {b for b in before if before[b] != after[b]} == {str(met)} and len(before) == 8
    read = table.read([met]).inputFiles()
    assert read and all(f"_bucket={met}/" in f for f in read)
    added = KeyedTable.open(spark, table.path).insert_if_absent(frame(spark, [("new", 1)])).manifest["parts"]
    assert sum(len(p) for p in added.values()) == sum(len(p) for p in after.values()) + 1  # nothing is rewritten


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_run_that_fails_changes_nothing(spark, table, monkeypatch, step):
    table = table.insert_if_absent(frame(spark, [("a", 1), ("b", 2)]))
    kept = content(table)
    own = getattr(KeyedTable, step)

    def killed(self, x):
        if step == "_write":
            own(self, x)  # the files are there, the manifest isn't
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, step, killed)
        for change in (table.upsert, table.insert_if_absent):
            with pytest.raises(KeyboardInterrupt):
                change(frame(spark, [("a", 5), ("c", 3)]))
    again = KeyedTable.open(spark, table.path)
    assert content(again) == kept
    assert content(again.upsert(frame(spark, [("a", 5), ("c", 3)]))) == [("a", 5), ("b", 2), ("c", 3)]


def test_of_two_writers_one_fails(spark, table):
    table.insert_if_absent(frame(spark, [("a", 1)]))
    with pytest.raises(keyed.Conflict):
        table.insert_if_absent(frame(spark, [("b", 1)]))
    assert content(KeyedTable.open(spark, table.path)) == [("a", 1)]
    assert content(KeyedTable.open(spark, table.path, 1)) == []


def test_a_batch_that_comes_again(spark, tmp_path, monkeypatch):
    """The run dies after the batch is in the table and before the stream has noted it."""
    rows = frame(spark, [("a", 1), ("a", 1), ("b", 2)])
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: stream_ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck"), buckets=4).awaitTermination(90)
    own = KeyedTable.compact

    def killed(self, most=8):
        raise RuntimeError("killed")

    monkeypatch.setattr(KeyedTable, "compact", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(KeyedTable, "compact", own)
    version = KeyedTable.open(spark, str(tmp_path / "out")).manifest["version"]
    run()
    out = KeyedTable.open(spark, str(tmp_path / "out"))
    assert out.manifest["version"] == version and content(out) == [("a", 1), ("b", 2)]
    frame(spark, [("b", 9), ("c", 3)]).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert content(KeyedTable.open(spark, str(tmp_path / "out"))) == [("a", 1), ("b", 2), ("c", 3)]


def test_store_keys_keeps_the_table(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "img_id string, v int")
    tables.store_keys(spark, "own_kept", rows, rows.select("img_id"), force=True)
    monkeypatch.setattr(type(spark.catalog), "refreshTable", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tables.store_keys(spark, "own_kept", rows.filter("v = 1").withColumn("v", rows["v"] + 5), rows.select("img_id"))
    monkeypatch.undo()
    spark.catalog.refreshTable("own_kept")
    assert sorted(map(tuple, spark.table("own_kept").collect())) == [("a", 6)]
    with pytest.raises(ValueError, match="other columns"):
        tables.store_keys(spark, "own_kept", rows.withColumn("w", rows["v"]), rows.select("img_id"), force=True)
