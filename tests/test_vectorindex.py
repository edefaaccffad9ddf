"""Search over stored blocks against the scan of all vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.operators import vectorindex, vectors


def made(spark, n=3000, dim=6, groups=12):
    r = np.random.default_rng(4)
    centres = r.normal(size=(groups, dim)) * 3
    data = centres[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * 0.15
    data[5] = 0
    data[10:40] = data[10]  # equal vectors
    rows = [(f"i{k:04d}", [float(x) for x in np.float32(v)]) for k, v in enumerate(data)] + [("none", None)]
    return spark.createDataFrame(rows, "img_id string, embedding array<float>").repartition(4), data


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_equals_the_scan(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(vectorindex, "BLOCK", 32)
    monkeypatch.setattr(vectorindex, "PIVOTS", 10)
    df, data = made(spark)
    scan = df.filter("embedding is not null")
    index = vectorindex.store(df, str(tmp_path / "v"), metric=metric)
    assert index.rows.count() == 3000 and index.blocks.agg(F.sum("n")).first()[0] == 3000
    only = df.filter("substring(img_id, 5, 1) in ('3', '7')")
    rounded = lambda out: sorted((round(r["distance"], 9), r["imgId"]) for r in out.collect())
    for query in (data[7], data[10], np.zeros(6), data.mean(axis=0), -data[100]):
        q = [float(x) for x in query]
        for k, limit, within in ((1, None, None), (35, None, None), (20, 0.01, None), (25, None, only), (9999, None, only)):
            assert rounded(vectorindex.search(index, q, k, limit, within)) == rounded(vectors.vector_search(scan, q, k=k, max_distance=limit, within=within, metric=metric))


def test_blocks_are_left_out_and_bounds_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 32)
    df, data = made(spark)
    index = vectorindex.store(df, str(tmp_path / "v"))
    query = [float(x) for x in data[7]]
    left, whole = vectorindex.open_blocks(index, query, 10), index.blocks.count()
    assert left.count() <= whole // 4
    near = vectorindex._measured(index, index.blocks, query, None).join(index.rows.select(F.col("img_id").alias("imgId"), "cell", "block"), "imgId")
    assert near.join(vectorindex.gaps(index, query), ["cell", "block"]).filter("distance < gap").count() == 0


def test_no_vectors(spark, tmp_path):
    df, _ = made(spark, 20)
    index = vectorindex.store(df.filter("img_id = 'none'"), str(tmp_path / "v"))
    assert vectorindex.search(index, [1.0] * 6).count() == 0
    with pytest.raises(ValueError, match="metric"):
        vectorindex.store(df, str(tmp_path / "w"), metric="dot")
