"""Phrases whose words come together more often than their parts make likely, by language.

Phrases are counted length by length in a HAT-trie: a shallow trie of word ids whose leaves are hash
containers of what follows; a container that grows too large bursts into children by the next word. A
trie that grows too large spills its largest subtrees whole, as sorted runs, which meet again by their
prefix. A phrase is counted only if both phrases of one word less that it holds are frequent. Pairs are
first counted in cells of a fixed number that they share by hash: a pair of a rare cell is rare itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.llm.common import cut, parts

#: Cells of the map of frequent phrases that tasks get are 2 ** BITS, a fixed size. A cell that phrases share
#: only lets some through that the count then finds to be rare. Stretches of cells are merged apart.
BITS, STRETCHES = 27, 1024
#: Cells that a task gathers before it hands them on.
CELLS = 4_000_000
#: Entries of a container that bursts, entries of a trie that spills, word ids that a task keeps.
BURST, MOST, WORDS = 4096, 600_000, 1_000_000
#: Rows of a run that are handed on at once.
RUN = 1 << 16
#: What bytes are: part of a word, between words, between pieces.
IN_WORD, BETWEEN, CUT = range(3)
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 0x09]] = BETWEEN
CLASSES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = CUT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_COUNTED = "lang string, phrase string, f bigint"
_CELLS = "stretch int, cells binary, counts binary"


class HatTrie:
    """Counts of phrases of ``length`` word ids. Keys are the ids' bytes, four for each."""

    def __init__(self, length: int):
        self.length, self.size, self.root = length, 0, {}

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """``rows``: distinct phrases, sorted by the first id."""
        heads = rows[:, 0]
        if self.length == 1:
            for h, c in zip(heads.tolist(), counts.tolist()):
                self.root[h] = self.root.get(h, 0) + c
            self.size = len(self.root)
            return
        tails = np.ascontiguousarray(rows[:, 1:]).view(f"V{4 * (self.length - 1)}").ravel().tolist()
        counts = counts.tolist()
        starts = np.flatnonzero(np.diff(heads, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(heads)]):
            head = int(heads[a])
            self.root[head] = self._added(self.root.get(head) or {}, tails[a:b], counts[a:b], self.length - 1)

    def _added(self, node: dict | _Node, tails: list[bytes], counts: list[int], left: int) -> dict | _Node:
        if isinstance(node, _Node):
            for tail, c in zip(tails, counts):
                word = tail[:4]
                node.children[word] = self._added(node.children.get(word) or {}, [tail[4:]], [c], left - 1)
            return node
        before, get = len(node), node.get
        for tail, c in zip(tails, counts):
            node[tail] = get(tail, 0) + c
        self.size += len(node) - before
        return self._burst(node) if left > 1 and len(node) > BURST else node

    @staticmethod
    def _burst(container: dict) -> _Node:
        out = _Node()
        for tail, c in container.items():
            out.children.setdefault(tail[:4], {})[tail[4:]] = c
        return out

    def _entries(self, node: dict | _Node, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        if isinstance(node, _Node):
            for word, child in node.children.items():
                yield from self._entries(child, prefix + word)
        else:
            for tail, c in node.items():
                yield prefix + tail, c

    def _held(self, node: dict | _Node) -> int:
        return sum(map(self._held, node.children.values())) if isinstance(node, _Node) else len(node)

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out the largest subtrees until ``down_to`` entries are left: (rows, counts) of each."""
        if self.length == 1:
            if self.root:
                yield np.array(list(self.root), np.int32)[:, None], np.array(list(self.root.values()), np.int64)
            self.root, self.size = {}, 0
            return
        sizes = sorted(((self._held(node), head) for head, node in self.root.items()), reverse=True)
        for held, head in sizes:
            if self.size <= down_to:
                return
            keys, counts = zip(*self._entries(self.root.pop(head), np.int32(head).tobytes()))
            self.size -= held
            yield np.frombuffer(b"".join(keys), np.int32).reshape(-1, self.length), np.array(counts, np.int64)


class _Node:
    """A burst container: children by the next word's id."""

    __slots__ = ("children",)

    def __init__(self):
        self.children: dict[bytes, dict | _Node] = {}


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, by their bytes."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    powers = np.cumprod(np.full(max(1, sizes.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers[place] * (data + np.uint64(1)))])
    out = sums[offsets[1:]] - sums[offsets[:-1]]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def of_language(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return word ^ (lang * np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """Cells of phrases from their words' hashes, place by place."""
    out = words[0].copy()
    for w in words[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out >> np.uint64(64 - BITS)


def _held(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Words:
    """The words of a batch of texts: their type (language and word), and which piece they are in."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column(1).fill_null("")
        langs = batch.column(0).fill_null("und").dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer()
        data = np.frombuffer(joined, np.uint8)
        kind = CLASSES[data]
        inside = np.zeros(len(data) + 2, bool)
        np.equal(kind, IN_WORD, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == CUT), starts)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        kept = LOWER[data[inside[1:-1]]]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
        self.dictionary, self.langs = words.dictionary, langs.dictionary
        self.type, size = words.indices.to_numpy(), max(1, len(words.dictionary))
        if len(self.langs) <= 1:
            self.lang_of, self.word_of = np.zeros(len(words.dictionary), np.int64), np.arange(len(words.dictionary))
        else:
            begins = np.cumsum(pc.binary_length(texts).to_numpy() + 1)
            lang = langs.indices.to_numpy()[np.searchsorted(begins, starts, "right")]
            types, self.type = np.unique(lang.astype(np.int64) * size + self.type, return_inverse=True)
            self.lang_of, self.word_of = types // size, types % size

    def named(self, types: np.ndarray) -> list[tuple[str, str]]:
        langs = self.langs.to_pylist()
        return [(langs[g], w) for g, w in zip(self.lang_of[types].tolist(), self.dictionary.take(pa.array(self.word_of[types])).to_pylist())]

    def totals(self) -> tuple[list[str], np.ndarray]:
        n = np.bincount(self.lang_of, np.bincount(self.type, minlength=len(self.lang_of)), len(self.langs)).astype(np.int64)
        return self.langs.to_pylist(), n

    def hashes(self) -> np.ndarray:
        """Of every word in order."""
        return of_language(hashes(self.langs)[self.lang_of], hashes(self.dictionary)[self.word_of])[self.type]

    def _within(self, length: int) -> np.ndarray:
        n = max(0, len(self.type) - length + 1)
        return self.piece[:n] == self.piece[len(self.piece) - n :]

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """Cells of the pairs of words that are both in the map ``words``."""
        own = self.hashes()
        known = _held(words, mixed([own]))
        at = np.flatnonzero(self._within(2) & known[:-1] & known[1:]) if len(own) > 1 else np.zeros(0, np.int64)
        return mixed([own[at], own[at + 1]])

    def phrases(self, length: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct phrases as rows of types, their counts). Of pairs those in the map, of longer phrases
        those whose two parts of one word less are in it."""
        if length == 1:
            return np.arange(len(self.word_of))[:, None], np.bincount(self.type, minlength=len(self.word_of))
        at = np.zeros(0, np.int64)
        if len(self.type) >= length:
            own = self.hashes()
            size = max(2, length - 1)
            part = _held(bitmap, mixed([own[k : len(own) - size + 1 + k] for k in range(size)]))
            at = np.flatnonzero(self._within(length) & (part if length == 2 else part[:-1] & part[1:]))
        key = self.type[at].astype(np.int64)
        for k in range(1, length):
            _, first, key = np.unique(key * len(self.word_of) + self.type[at + k], return_index=True, return_inverse=True)
        rows = np.stack([self.type[at[first] + k] for k in range(length)], axis=1) if len(at) else np.zeros((0, length), np.int64)
        return rows, np.bincount(key, minlength=len(rows))


def _count(length: int, bitmap) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[tuple[str, str], int] = {}
        trie = HatTrie(length)
        frequent = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None

        def runs(down_to: int) -> Iterator[pa.RecordBatch]:
            names, out = list(ids), []

            def handed(least: int) -> Iterator[pa.RecordBatch]:
                nonlocal out
                while len(out) >= least:
                    phrase, lang, f = zip(*out[:RUN])
                    yield pa.record_batch({"lang": pa.array(lang), "phrase": pa.array(phrase), "f": pa.array(f, pa.int64())})
                    out = out[RUN:]

            for rows, counts in trie.spill(down_to):  # subtree by subtree, each sorted
                words = [[names[i][1] for i in row] for row in rows.tolist()]
                out += sorted(zip(map(" ".join, words), [names[i][0] for i in rows[:, 0].tolist()], counts.tolist()))
                yield from handed(RUN)
            yield from handed(1)

        for batch in batches:
            for part in parts(batch, 1):
                words = Words(part)
                if not len(words.type):
                    continue
                if length == 1:
                    lang, n = words.totals()
                    yield pa.record_batch({"lang": pa.array(lang), "phrase": pa.nulls(len(n), pa.string()), "f": pa.array(n)})
                rows, counts = words.phrases(length, frequent)
                used = np.unique(rows)
                known = np.zeros(len(words.word_of), np.int32)
                known[used] = [ids.setdefault(t, len(ids)) for t in words.named(used)]
                rows = known[rows]
                order = np.argsort(rows[:, 0], kind="stable")
                trie.add(rows[order], counts[order])
                if len(ids) > WORDS:
                    yield from runs(0)
                    ids.clear()
                elif trie.size > MOST:
                    yield from runs(MOST // 2)
        yield from runs(0)

    return run


def count_phrases(docs: DataFrame, length: int, least: int, bitmap: bytes | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``length`` words that come ``least`` times; with one word also
    a row of each language without a phrase: its number of words."""
    sc = docs.sparkSession.sparkContext
    runs = docs.mapInArrow(_count(length, sc.broadcast(bitmap) if bitmap is not None else None), _COUNTED)  # 2 ** BITS bits
    prefix = F.xxhash64("lang", F.substring_index("phrase", " ", 2))  # runs of a prefix meet in one partition
    merged = runs.withColumn("prefix", prefix).repartition("prefix").groupBy("prefix", "lang", "phrase").agg(F.sum("f").alias("f"))
    return cut(merged.filter((F.col("f") >= least) | F.col("phrase").isNull()).select("lang", "phrase", "f"))


def _assembled(rows: DataFrame) -> bytes | None:
    """One map from rows (stretch, bits); None if no bit is set. 2 ** BITS bits at most come to the driver."""
    size = (1 << BITS - 3) // STRETCHES
    found, out = rows.toArrow(), bytearray(1 << BITS - 3)
    for k, bits in zip(found["stretch"].to_pylist(), found["bits"].to_pylist()):
        out[k * size : (k + 1) * size] = bits
    return bytes(out) if any(np.frombuffer(out, np.uint64)) else None


def _merge_cells(least: int) -> callable:
    """Of rows (stretch, cells, counts) by stretch: its bits, set where a cell's counts reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, at, sums = (1 << BITS) // STRETCHES, None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch({"stretch": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])})

        for batch in batches:
            for k, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if k != at:
                    if at is not None:
                        yield done()
                    at, sums = k, np.zeros(size, np.int64)
                cells = np.cumsum(np.frombuffer(zstandard.decompress(cells), np.uint32).astype(np.int64))
                sums[cells] += np.frombuffer(zstandard.decompress(counts), np.uint16)
        if at is not None:
            yield done()

    return run


def _cells(counted: bool, least: int, bitmap) -> callable:
    """Rows (stretch, cells, counts) of the pairs in texts, or of rows (lang, phrase) that count ``least``
    each. Cells are the gaps between sorted ones; a count of ``least`` stands for any larger one."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        words = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for part in parts(batch, 1):
                yield Words(part).pairs(words)

    def of_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column(1), " ")
                own = hashes(words.flatten()).reshape(batch.num_rows, -1)  # phrases of one length
                own = of_language(hashes(batch.column(0))[:, None], own)
                yield mixed(list(own.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n if not counted else least, least).astype(np.uint16) * np.ones(len(cells), np.uint16)
            size = (1 << BITS) // STRETCHES
            stretch = (cells // np.uint64(size)).astype(np.int64)
            starts = np.flatnonzero(np.diff(stretch, prepend=-1))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
                own = (cells[a:b] - np.uint64(int(stretch[a]) * size)).astype(np.uint32)
                out.append((int(stretch[a]), zstandard.compress(np.diff(own, prepend=np.uint32(0)).tobytes(), 1), zstandard.compress(n[a:b].tobytes(), 1)))
            if out:
                k, c, m = zip(*out)
                yield pa.record_batch({"stretch": pa.array(k, pa.int32()), "cells": pa.array(c, pa.binary()), "counts": pa.array(m, pa.binary())})

        held, size = [], 0
        for found in (of_phrases if counted else of_texts)(batches):
            held.append(found)
            size += len(found)
            if size > CELLS:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    return run


def _bits(cells: DataFrame, least: int) -> bytes | None:
    dealt = cells.repartition("stretch").sortWithinPartitions("stretch")
    return _assembled(dealt.mapInArrow(_merge_cells(least), "stretch int, bits binary"))


def bitmap_of(counted: DataFrame) -> bytes | None:
    """Bits of the cells of a table's phrases, which have one length; None if it has none."""
    rows = counted.filter("phrase IS NOT NULL").select("lang", "phrase")
    return _bits(rows.mapInArrow(_cells(True, 1, None), _CELLS), 1)


def frequent_pairs(docs: DataFrame, least: int, words: bytes) -> bytes | None:
    """Bits of the cells whose pairs of words, together, come ``least`` times: all others are rare."""
    cells = docs.mapInArrow(_cells(False, least, docs.sparkSession.sparkContext.broadcast(words)), _CELLS)  # 2 ** BITS bits
    return _bits(cells, least)


def score(a: Column, l: Column, r: Column, n: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = (F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n)).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)")
    return F.call_function("div", over, under)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covers: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase comes ``least`` times or more inside pieces of texts; its score is that of its weakest
    cut. One that lies inside a longer one that comes ``covers`` % as often is left out. Null texts
    are empty, a null lang is ``und``; equal rows of ``docs`` count each. Other columns are left out.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    levels, bitmap = [], None
    for length in range(1, longest + 1):
        levels.append(count_phrases(rows, length, least, bitmap))
        if length < longest and (bitmap := bitmap_of(levels[-1])) is None:
            break
        if length == 1 and longest > 1 and (bitmap := frequent_pairs(rows, least, bitmap)) is None:
            break
    totals = levels[0].filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    counted = reduce(DataFrame.unionByName, levels).filter("phrase IS NOT NULL")
    found = counted.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).filter(F.size("words") > 1)
    span = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    size = F.size("words")
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("left"), span(F.col("k") + 1, F.greatest(size - F.col("k"), F.lit(0))).alias("right"))
    side = lambda part, f: counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("score", score(F.col("a"), F.col("l"), F.col("r"), F.col("n")))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    longer = found.filter(size > 2).select("lang", "a", F.explode(F.array_distinct(inside)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("in_longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(~(F.lit(100) * F.coalesce("in_longer", F.lit(0)) >= F.lit(covers) * F.col("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
