"""The stored text index against scores computed row by row."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from taxaspark.operators import fulltext, textindex
from taxaspark.sources import stored

WORDS = "red fox blue été wolf the lake moth fern sand".split()


def texts(n, seed=5):
    state, out = seed, []
    for k in range(n):
        row = []
        for c in range(2):
            own = []
            for _ in range((k * 7 + c * 3) % 23):
                state = (state * 1103515245 + 12345) % (1 << 31)
                own.append(WORDS[min((state >> 16) % 14, 9)] if k % 50 else "lynx")
            row.append(" ".join(own) if k % 31 or c else None)
        out.append((k, f"species {k % 17}" if k % 29 else [None, " "][k % 2], *row))
    return out


def plain_scores(rows, terms, columns):
    """BM25 by its formula."""
    names = ("id", "species", "title", "text")
    own = {}
    for r in rows:
        words = []
        for c in columns:
            folded = (r[names.index(c)] or "").lower().translate(str.maketrans(*fulltext.ACCENTS))
            words += [w for w in re.split("[^a-z]+", folded) if w and w not in fulltext.STOP_WORDS]
        own[r[0]] = words
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    df = {t: sum(t in w for w in own.values()) for t in terms}
    score = {}
    for key, words in own.items():
        held = [t for t in terms if t in words]
        if held:
            score[key] = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in held)
    return score


@pytest.fixture(scope="module")
def rows():
    return texts(2000)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    kept, textindex.BLOCK = textindex.BLOCK, 32
    df = spark.createDataFrame(rows, "id long, species string, title string, text string")
    made = fulltext.store_fts(df, "id", ["title", "text"], str(tmp_path_factory.mktemp("index") / "i"))
    textindex.BLOCK = kept
    return df, made


@pytest.mark.parametrize("fields", [None, ["title"], ["text"], ["title", "text"]])
@pytest.mark.parametrize("query", ["lynx", "Red, ete the", "fox wolf sand moth", "nowhere", ""])
def test_scores(index, rows, fields, query):
    got = {r["id"]: r["score"] for r in fulltext.bm25(index[1], query, fields).collect()}
    assert got == pytest.approx(plain_scores(rows, fulltext.query_terms(query), fields or ["title", "text"]))


def test_some_of_three_columns(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "id long, species string, title string, text string")
    made = fulltext.store_fts(df, "id", ["species", "title", "text"], str(tmp_path / "i"))
    got = {r["id"]: r["score"] for r in fulltext.bm25(made, "red fox", ["title", "text"]).collect()}
    assert got == pytest.approx(plain_scores(rows, ["red", "fox"], ["title", "text"]))
    assert fulltext.bm25(fulltext.open_fts(spark, str(tmp_path / "i")), "red fox").count() == len(plain_scores(rows, ["red", "fox"], ["species", "title", "text"]))


@pytest.mark.parametrize("query,k", [("lynx", 3), ("red fox", 10), ("blue moth fern", 5), ("ete", 5000)])
@pytest.mark.parametrize("unique", [True, False])
def test_best_rows_are_those_of_the_scan(index, rows, query, k, unique):
    df, made = index
    columns = ["title", "text"]
    got, scan = (fulltext.fts_search(df, "id", columns, query, unique, k, i).collect() for i in (made, None))
    assert [tuple(r) for r in got] == [tuple(r) for r in scan]
    score = plain_scores(rows, fulltext.query_terms(query), columns)
    best, seen = [], set()
    for key in sorted(score, key=lambda i: (-score[i], i)):
        if not unique or rows[key][1] not in seen:
            best.append(key)
            seen.add(rows[key][1])
    assert [r["id"] for r in got] == [i for i in best[:k] if rows[i][1] and rows[i][1].strip()]


def test_blocks_are_left_out(index):
    """Few blocks can hold the best row; bounds hold for every row."""
    _, made = index
    all_blocks = textindex.bounds(made, ["lynx", "red"])
    left = textindex.open_blocks(made, ["lynx", "red"], 1).count()
    assert left <= all_blocks.count() // 2
    place = made.postings.filter("field = ''").select("block", F.explode("entries.id").alias("id")).distinct()
    over = fulltext.bm25(made, "lynx red").join(place, "id").join(all_blocks, "block").filter("score > bound")
    assert over.count() == 0


def test_a_rare_term_reads_few_rows(spark, small, tmp_path):
    """A query's term reaches the scan, and row groups are sorted by term."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    made = fulltext.store_fts(df, "doc_id", ["text"], str(tmp_path / "i"))
    hits = textindex.bounds(made, ["heat"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,heat)" in plan and "entries" not in plan.split("ReadSchema")[1].split("\n")[0]
    first = made.postings.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(first, first[1:]))


def test_once(spark, tmp_path):
    source, made = str(tmp_path / "t"), []
    spark.range(3).write.parquet(source)
    make = lambda to: made.append(to)
    a = stored.once(spark, "x", [source], make)
    assert stored.once(spark, "x", [source], make) == a and made == [a]
    spark.range(5).write.mode("overwrite").parquet(source)
    assert stored.once(spark, "x", [source], make) != a and len(made) == 2
    with pytest.raises(ZeroDivisionError):
        stored.once(spark, "y", [source], lambda to: 1 / 0)
    stored.once(spark, "y", [source], make)
    assert len(made) == 3


def test_a_text_is_cut_once(spark, tmp_path):
    """Also of a text without words there is a length; no text is cut again for the sort or the lengths."""
    seen = spark.sparkContext.accumulator(0)

    def cut(text):
        seen.add(1)
        return (text or "").split()

    rows = [(k, f"fox owl{k} " * (k % 3) + "bat") for k in range(40)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    made = textindex.store(df, "id", ["text"], str(tmp_path / "i"), F.udf(cut, "array<string>"))
    assert seen.value == len(rows)
    assert {r["id"]: r["len"] for r in made.lengths.collect()} == {k: len((t or "").split()) for k, t in rows}
    held = {r["term"]: [tuple(e) for e in r["entries"]] for r in made.postings.collect()}
    assert held["fox"] == [(k, k % 3, 2 * (k % 3) + 1) for k in range(40) if k % 3] and None not in held
    assert {r["term"]: r["df"] for r in made.terms.collect()} == {t: len(e) for t, e in held.items()}
