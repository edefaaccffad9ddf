"""Byte-level BPE encoding and decoding by a rank file.

A text is cut by a pattern; each piece is a row of byte ids in a padded matrix of pieces of like
length. Each round every row merges its leftmost pair of the least rank, and is packed again; rows
without a pair leave. A pair's rank comes from a hash table of all pairs that make a token.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from taxaspark.llm.common import BYTES, parts

#: Rank of a pair that makes no token.
NONE = np.int32(2**31 - 1)
#: Cells of a matrix of pieces; pieces that are longer than ``LONG`` bytes are merged by a heap instead.
CELLS, LONG = 1 << 16, 256
#: Pieces that a worker remembers; beyond, it forgets them all.
KNOWN = 300_000
#: White space as Unicode's property has it: ``regex`` also counts four separators as such.
_SPACE = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}


def compiled(pattern: str) -> regex.Pattern:
    for short, full in _SPACE.items():
        pattern = pattern.replace(short, full)
    return regex.compile(pattern)


class Pairs:
    """Hash table from a pair of ids to the id of the token that they make; open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(4 * len(made)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, NONE, np.int32)
        keys = self._key(left, right)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.made[slots[put]] = keys[put], made[put]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the tokens that pairs make; ``NONE`` for others and where an id is negative."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.made[slots], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.made[slots[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Tokens by rank. Every byte must be a token; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.get)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.lengths, self.starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ids = np.array([ranks[t] for t in tokens])
        self.lengths[ids] = [len(t) for t in tokens]
        self.starts[ids] = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @cached_property
    def pairs(self) -> Pairs:
        ranks = self.ranks
        cuts = ((ranks.get(t[:k]), ranks.get(t[k:]), i) for t, i in ranks.items() for k in range(1, len(t)))
        made = np.array([c for c in cuts if c[0] is not None and c[1] is not None], np.int64).reshape(-1, 3)
        return Pairs(made[:, 0], made[:, 1], made[:, 2].astype(np.int32))

    @cached_property
    def made(self) -> dict[tuple[int, int], int]:
        held = self.pairs.keys >= 0
        keys = self.pairs.keys[held]
        return dict(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()), self.pairs.made[held].tolist()))

    def merge_long(self, piece: bytes) -> list[int]:
        """Merges one long piece: a heap of (rank, place) over a linked list, in the same order."""
        ids, n = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before, made = list(range(1, n + 1)), list(range(-1, n - 1)), self.made
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := made.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            gone = after[k]
            if ids[k] != left or gone >= n or ids[gone] != right:
                continue  # one of the two has merged since
            ids[k], ids[gone] = rank, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := made.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def merge_rows(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pieces, shortest first: (numbers of pieces, their counts of ids, ids one after another)."""
        width = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        full = np.arange(width) < sizes[:, None]
        ids = np.full(full.shape, -1, np.int32)
        ids[full] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = np.arange(len(pieces))
        rank = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                live = best != NONE
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                done = ids[~live]
                yield rows[~live], (done >= 0).sum(axis=1), done[done >= 0]
                rows, ids, rank = rows[live], ids[live], rank[live]
                if not len(rows):
                    return
                at, best = at[live], best[live]
            each = np.arange(len(rows))
            ids[each, at] = best
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            place = place[:-1]
            if not len(place):
                rank = rank[:, :0]
                continue
            rank = np.take_along_axis(rank, place + (place > at[:, None]), axis=1)
            for side in (at - 1, at):  # the pairs that the merged token is now in
                has = (side >= 0) & (side < len(place))
                rank[each[has], side[has]] = self.pairs.rank(ids[each[has], side[has]], ids[each[has], side[has] + 1])
            used = int((ids >= 0).any(axis=0).sum())  # drop columns that only pad
            ids, rank = ids[:, :used], rank[:, : max(0, used - 1)]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of ids by piece, all ids in order). A piece that is a token stays whole."""
        order, sizes, flat, todo = [], [], [], []
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is None and len(p) <= LONG:
                todo.append(k)
                continue
            ids = [whole] if whole is not None else self.merge_long(p)
            order.append([k])
            sizes.append([len(ids)])
            flat.append(np.array(ids, np.int32))
        todo.sort(key=lambda k: len(pieces[k]))
        at = 0
        while at < len(todo):
            # bucket: pieces of at most 1.5 times the shortest one's length, in a matrix of bounded size
            least = len(pieces[todo[at]])
            end = at + 1
            while end < len(todo) and (width := len(pieces[todo[end]])) <= least + least // 2 and (end - at + 1) * width <= CELLS:
                end += 1
            bucket = np.array(todo[at:end])
            for rows, counts, ids in self.merge_rows([pieces[k] for k in todo[at:end]]):
                order.append(bucket[rows])
                sizes.append(counts)
                flat.append(ids)
            at = end
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        order, sizes, flat = (np.concatenate(x) for x in (order, sizes, flat))
        counts, starts = np.zeros((2, len(pieces)), np.int64)
        counts[order], starts[order] = sizes, np.cumsum(sizes) - sizes
        return counts, flat[spread(starts, counts)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each id, all bytes one after another)."""
        counts = self.lengths[ids]
        return counts, self.bytes[spread(self.starts[ids], counts)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    """Encodes texts; remembers up to ``KNOWN`` pieces with their ids in one array."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.cut = vocab, compiled(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def learn(self, pieces: list[str]) -> None:
        counts, ids = self.vocab.encode_pieces([p.encode() for p in pieces])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.pool)])
        self.counts, self.pool = np.concatenate([self.counts, counts]), np.concatenate([self.pool, ids])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of ids by text, all ids in order)."""
        cuts = [self.cut.findall(t) for t in texts]
        pieces = pa.array(chain.from_iterable(cuts), pa.string()).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.known) + len(distinct) > KNOWN:
            self.forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            self.learn(new)
        rows = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        counts = self.counts[rows]
        ids = self.pool[spread(self.starts[rows], counts)]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        return np.bincount(owner, counts, len(texts)).astype(np.int64), ids


def _joined(chunks: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(chunks) if chunks else pa.array([], kind)


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """Ids of whole texts, array<int>: each match of ``pattern`` by itself, without special tokens.

    ``path`` names a rank file that every worker can read. Null and empty texts have no ids; equal
    texts have equal ids; a piece of any length is encoded whole.
    """

    @arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary(path), pattern)
        for batch in batches:
            chunks = []
            for part in parts(pa.record_batch([batch], ["text"]), 0):
                counts, ids = encoder([t or "" for t in part.column(0).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                chunks.append(pa.ListArray.from_arrays(ends, pa.array(ids)))
            yield _joined(chunks, pa.list_(pa.int32()))

    return ids_of(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, path: str) -> Column:
    """Bytes that ids stand for, binary; empty for null and for no ids. A null or an id that the
    rank file doesn't have is an error."""

    @arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in batches:
            flat, counts = batch.flatten(), batch.value_lengths().fill_null(0).to_numpy()
            if flat.null_count:
                raise ValueError("an id is null")
            chunks, at, row = [], 0, 0
            ends = np.cumsum(counts)
            while row < len(batch):
                stop = max(row + 1, int(np.searchsorted(ends, at + BYTES, "right")))
                own = flat.slice(at, int(ends[stop - 1]) - at).to_numpy()
                if len(own) and (own.min() < 0 or own.max() >= len(vocab.lengths) or not vocab.lengths[own].all()):
                    raise ValueError("an id is not in the rank file")
                sizes, data = vocab.decode(own)
                to = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends[row:stop] - at])].astype(np.int32)
                chunks.append(pa.Array.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer(to), pa.py_buffer(data)]))
                at, row = int(ends[stop - 1]), stop
            yield _joined(chunks, pa.binary())

    return bytes_of(F.col(ids) if isinstance(ids, str) else ids)
