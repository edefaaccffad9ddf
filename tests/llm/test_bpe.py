"""Byte-level BPE against a plain merge loop and against the public tokenizer library."""

from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxaspark.llm import bpe
from taxaspark.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "it's we'll 'stuff' 12abc", " \n\n  x\t\ty  ", "äöü ßtraße 東京 😀😀", "a" * 700, "ab" * 4000, "\x1c \x85 end", "x" * 300 + " " * 300 + "\n"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


def plain_merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min((ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
        if best[0] == 1 << 40:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


#: A small vocabulary in which a merged token can take part in a pair of lower rank.
SMALL = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate((b"abc", b"bc", b"ab", b"aab", b"cab", b"abab", b"bb"))}


@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_rows_and_heap_merge_as_plainly(words):
    vocab = bpe.Vocabulary(SMALL)
    pieces = [w.encode() for w in words]
    wanted = [[SMALL[p]] if p in SMALL else plain_merge(SMALL, p) for p in pieces]
    counts, ids = vocab.encode_pieces(pieces)
    at, got = 0, []
    for n in counts:
        got.append(ids[at : at + n].tolist())
        at += n
    assert got == wanted
    assert [vocab.merge_long(p) for p in pieces] == [plain_merge(SMALL, p) for p in pieces]


@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_text_as_the_library(library, texts):
    encoder = bpe.Encoder(bpe.vocabulary(PATH), P.PATTERN)
    counts, ids = encoder(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert counts.tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_every_code_point(library):
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b'{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    counts, ids = bpe.Encoder(bpe.vocabulary(PATH), P.PATTERN)(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    encoder = bpe.Encoder(bpe.vocabulary(PATH), P.PATTERN)
    for t in ("one two three four", "five one six", "one two"):
        assert encoder([t])[1].tolist() == library.encode_ordinary(t)


def test_columns(spark, library, monkeypatch):
    monkeypatch.setattr("taxaspark.llm.common.BYTES", 50)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS + TEXTS)], "doc_id int, text string, `ids.x` string")
    got = df.withColumn("ids", bpe.encode("text", PATH, P.PATTERN)).withColumn("back", bpe.decode("ids", PATH)).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [library.encode_ordinary(t or "") for t in TEXTS + TEXTS]
    assert [bytes(r["back"]) for r in got] == [(t or "").encode() for t in TEXTS + TEXTS]
    none = df.limit(0).withColumn("ids", bpe.encode("text", PATH, P.PATTERN)).withColumn("back", bpe.decode("ids", PATH))
    assert none.collect() == []
    assert [bytes(r[0]) for r in spark.sql("SELECT CAST(NULL AS array<int>) AS ids").select(bpe.decode("ids", PATH)).collect()] == [b""]
    with pytest.raises(Exception, match="not in the rank file"):
        spark.range(1).select(bpe.decode(F.array(F.lit(60000)), PATH)).collect()


def test_query(spark, small, library):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op13_byte_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        written = " ".join(map(str, ids)).encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
