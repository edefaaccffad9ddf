"""Phrase mining against plain counting of all phrases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from taxaspark.llm import phrases
from taxaspark.llm.queries import ORACLE_SQL, QUERIES


def plain(docs, least, longest=5, top=2000, covers=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    rows = defaultdict(list)
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in cands.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                if 100 * a >= covers * cands[lang, words[k : k + size]]:
                    covered.add((lang, words[k : k + size]))
    for (lang, words), a in cands.items():
        if (lang, words) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            rows[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top])}


def mined(df, **options):
    out = [tuple(r) for r in phrases.phrases(df, **options).collect()]
    assert len(out) == len(set(out))
    return set(out)


def made(spark, n=400):
    state, docs = 7, []
    words = "the of Then, ÄÖ é wet day. night? ab\tcd; x\x00y THE the of 東京 red\nblue".split(" ")
    for k in range(n):
        text = []
        for _ in range(k % 60):
            state = (state * 1103515245 + 12345) % (1 << 31)
            text.append(words[(state >> 16) % len(words)] if state >> 20 & 3 else "of the day")
        docs.append((["en", "de", None, "und"][k % 4], " ".join(text) if k % 13 else None))
    return docs, spark.createDataFrame([(*d, "x") for d in docs], "lang string, text string, `a.b` string").repartition(3)


@pytest.mark.parametrize("least,covers", [(1, 100), (5, 100), (3, 60)])
def test_all_phrases(spark, least, covers):
    docs, df = made(spark)
    assert mined(df, least=least, covers=covers, top=200) == plain(docs, least, top=200, covers=covers)


def test_bursts_spills_and_shared_bits(spark, monkeypatch):
    """Small containers, tries, batches and maps change nothing. Local workers are forked with these."""
    docs, df = made(spark)
    monkeypatch.setattr("taxaspark.llm.common.BYTES", 300)
    trie, rows = phrases.HatTrie(4), defaultdict(int)
    monkeypatch.setattr(phrases, "BURST", 5)
    rng = np.random.default_rng(3)
    got = Counter()
    for _ in range(40):
        keys, counts = np.unique(rng.integers(0, 6, (50, 4)).astype(np.int32), axis=0, return_counts=True)
        for key, c in zip(keys.tolist(), counts.tolist()):
            rows[tuple(key)] += c
        trie.add(keys, counts)
        if trie.size > 300:
            for out, n in trie.spill(100):
                got.update({tuple(k): 0 for k in out.tolist()})
                for k, c in zip(out.tolist(), n.tolist()):
                    got[tuple(k)] += c
            assert trie.size <= 300 and trie.size == sum(trie._held(x) for x in trie.root.values())
    for out, n in trie.spill(0):
        for k, c in zip(out.tolist(), n.tolist()):
            got[tuple(k)] += c
    assert got == rows and trie.size == 0

    import pyarrow as pa

    monkeypatch.setattr(phrases, "MOST", 20)
    monkeypatch.setattr(phrases, "WORDS", 15)
    batches = [pa.record_batch({"lang": pa.array([d[0] for d in docs[k : k + 50]]), "text": pa.array([d[1] for d in docs[k : k + 50]])}) for k in range(0, len(docs), 50)]
    for size in (1, 2, 3):
        full = type("B", (), {"value": b"\xff" * (1 << phrases.BITS - 3)})  # every bit is shared
        counted = Counter()
        for b in phrases._count(size, full)(iter(batches)):
            for r in b.to_pylist():
                counted[r["lang"], r["phrase"]] += r["f"]
        wanted = Counter()
        for lang, text in docs:
            for piece in re.split("[.,;:!?\n\v\f\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
                words = [w for w in re.split("[ \t]", piece) if w]
                for k in range(len(words) - size + 1):
                    wanted[lang or "und", " ".join(words[k : k + size])] += 1
        assert {k: v for k, v in counted.items() if k[1] is not None} == wanted


def test_scores_beyond_64_bits(spark):
    big = [(10**12 + 7, 10**13 + 1, 3 * 10**12 + 5, 7 * 10**13 + 9), (100, 100, 100, 10**15), (5, 7, 11, 13)]
    got = spark.createDataFrame(big, "a bigint, l bigint, r bigint, n bigint").select(phrases.score(F.col("a"), F.col("l"), F.col("r"), F.col("n"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (l * r) for a, l, r, n in big]


def test_nothing(spark):
    df = spark.createDataFrame([(None, None), ("en", ""), ("en", " ., \n")], "lang string, text string")
    assert mined(df, least=1) == mined(df.limit(0), least=1) == set()
    assert mined(spark.createDataFrame([("en", "one")], "lang string, text string"), least=1) == set()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert oracle.spark_rows(QUERIES["op12_collocations"](spark, folder)) == oracle.sql_rows(ORACLE_SQL["op12_collocations"], folder)


def test_query_against_counting(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").collect()]
    assert set(map(tuple, QUERIES["op12_collocations"](spark, small).collect())) == plain(docs, 100)
    assert mined(spark.read.parquet(f"{small}/documents.parquet"), least=4) == plain(docs, 4)
